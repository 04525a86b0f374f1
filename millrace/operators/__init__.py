"""DataFrame -> DataFrame functions, generic over the roles of columns. None collects rows or does I/O."""
