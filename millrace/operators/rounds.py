"""Discovery rounds and their audits: registered sources, round creation, audit records, quarantines, covered fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import broadcast_if_few, staged
from .relational import fingerprint

#: Forms of identifiers (fixed values).
FINGERPRINT = r"\A[0-9a-f]{64}\z"
ROUND_NAME = r"\A[a-z0-9][a-z0-9_-]{2,99}\z"
SOURCE_ID = r"\A[a-z][a-z0-9_]{2,49}\z"
PLATFORM = r"\A[a-z][a-z0-9_]{0,49}\z"
#: States of a request that is still to be answered (fixed values).
ACTIVE = ["queued", "running"]


def _formed(value: str | Column, pattern: str) -> Column:
    return F.coalesce((F.col(value) if isinstance(value, str) else value).rlike(pattern), F.lit(False))


def _first_reason(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule that holds (null counts as not), null where none does."""
    return F.coalesce(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(reason)) for rule, reason in rules])


def registry_errors(entries: DataFrame) -> DataFrame:
    """Entries (id, base_url, roles, requests_per_second, enabled) with `error`, the first rule that they break: ids have a form
    and are unique, there is a role, the rate is above 0 and at most 1, and none is disabled."""
    ids = entries.groupBy("id").agg(F.count("*").alias("_n"))
    error = _first_reason(
        (~_formed("id", SOURCE_ID), "invalid_id"), (F.col("_n") > 1, "repeated_id"), (~F.coalesce(F.size("roles") > 0, F.lit(False)), "no_role"),
        (~F.coalesce((F.col("requests_per_second") > 0) & (F.col("requests_per_second") <= 1), F.lit(False)), "invalid_rate"), (~F.coalesce("enabled", F.lit(False)), "disabled"),
    )
    return entries.join(ids, "id", "left").withColumn("error", error).select(*entries.columns, "error")


def registered(candidates: DataFrame, registry: DataFrame, role: str = "candidate_pool") -> DataFrame:
    """Candidates (source_id, source_url) with `registered`: whether their source is there, has the role, and has that very URL."""
    known = registry.select(F.col("id").alias("source_id"), F.col("base_url").alias("_url"), F.array_contains("roles", role).alias("_role"))
    good = F.coalesce(F.col("_role") & (F.col("_url") == F.col("source_url")), F.lit(False))
    return candidates.join(known, "source_id", "left").withColumn("registered", good).select(*candidates.columns, "registered")


_STORED = ["config_fingerprint", "model_fingerprint", "predecessor_id", "started_at"]
_MEMBERSHIP = ["membership_fingerprint", "member_count"]


def round_outcomes(proposals: DataFrame, stored: DataFrame, manifests: DataFrame) -> DataFrame:
    """Proposals of rounds (round_id, manifest_version, name, both fingerprints, predecessor_id, started_at, membership_fingerprint,
    member_count) with `outcome`. A name belongs to one round of a manifest: the stored one, else the earliest sound proposal
    (ties: least id), which is `created`; an equal proposal is `replayed`, another is `conflicting_membership` or
    `conflicting_round`. The other outcomes are the rule that a proposal breaks by itself. A predecessor must be a stored round of
    the manifest that started earlier; it is looked at only where the name is free.

    Proposals without a predecessor aren't dealt by it, and a few manifests are sent to the proposals, since either key would put
    most proposals into a few tasks."""
    versions = staged(manifests.select(F.col("version").alias("manifest_version"), F.lit(True).alias("_known")).distinct(), "versions")
    before = stored.select(F.col("round_id").alias("predecessor_id"), F.col("manifest_version").alias("_version"), F.col("started_at").alias("_began"))
    facts = F.struct(*_MEMBERSHIP, *_STORED)
    taken = stored.select("manifest_version", "name", facts.alias("_taken"))
    known = proposals.join(broadcast_if_few(versions)(versions), "manifest_version", "left")
    following = known.where("predecessor_id IS NOT NULL").join(before, "predecessor_id", "left")
    leading = known.where("predecessor_id IS NULL").withColumns({c: F.lit(None).cast(before.schema[c].dataType) for c in ("_version", "_began")})
    joined = following.unionByName(leading).join(taken, ["manifest_version", "name"], "left")
    member, number = F.col("membership_fingerprint"), F.col("member_count")
    unsound = _first_reason(
        (~_formed("name", ROUND_NAME), "invalid_name"),
        (~(_formed("manifest_version", FINGERPRINT) & _formed("config_fingerprint", FINGERPRINT) & _formed("model_fingerprint", FINGERPRINT)), "invalid_fingerprint"),
        (member.isNull() != number.isNull(), "incomplete_membership"), (member.isNotNull() & ~(_formed(member, FINGERPRINT) & (number >= 1)), "invalid_membership"),
        (F.col("_known").isNull(), "unknown_manifest"),
    )
    headless = _first_reason(
        (F.col("predecessor_id").isNotNull() & ~F.coalesce(F.col("_version") == F.col("manifest_version"), F.lit(False)), "unknown_predecessor"),
        (F.col("started_at") <= F.col("_began"), "not_after_predecessor"),
    )
    judged = joined.withColumn("_unsound", unsound).withColumn("_headless", headless)
    free = judged.where("_unsound IS NULL AND _headless IS NULL AND _taken IS NULL")
    firsts = free.groupBy("manifest_version", "name").agg(F.min_by(F.struct("round_id", facts.alias("facts")), F.struct("started_at", "round_id")).alias("_first"))
    decided = judged.join(firsts, ["manifest_version", "name"], "left")
    held = F.coalesce("_taken", "_first.facts")
    own = F.col("_taken").isNull() & (F.col("_first.round_id") == F.col("round_id"))
    earlier = F.col("_taken").isNotNull() | (F.struct("started_at", "round_id") > F.struct(F.col("_first.facts.started_at"), F.col("_first.round_id")))
    differs = lambda names: ~F.struct(*names).eqNullSafe(F.struct(*[held[n].alias(n) for n in names]))
    outcome = F.coalesce(
        F.col("_unsound"),
        F.when(F.coalesce(own, F.lit(False)), F.lit("created")),
        F.when(
            held.isNotNull() & F.coalesce(earlier, F.lit(False)),
            F.when(differs(_MEMBERSHIP), F.lit("conflicting_membership")).when(differs(_STORED), F.lit("conflicting_round")).otherwise(F.lit("replayed")),
        ),
        F.col("_headless"),
    )
    return decided.withColumn("outcome", outcome).select(*proposals.columns, "outcome")


def audit_outcomes(selections: DataFrame, observations: DataFrame, stored: DataFrame) -> DataFrame:
    """Selections (round_id, observation_id, source_id, platform, selected_at) with `outcome`: `recorded`, `replayed` where the
    same one is stored, or the rule that is broken. Of several sound ones for an observation the earliest counts as stored for the
    others (ties: least source and platform)."""
    on, facts = ["round_id", "observation_id"], ["source_id", "platform", "selected_at"]
    seen = observations.select(*on, F.col("status").alias("_status"), F.col("source_id").alias("_source"), F.col("platform").alias("_platform"), F.col("observed_at").alias("_at"))
    joined = selections.join(seen, on, "left").join(stored.select(*on, F.struct(*facts).alias("_stored")), on, "left")
    broken = _first_reason(
        (~_formed("source_id", SOURCE_ID), "invalid_source"), (~_formed("platform", PLATFORM), "invalid_platform"), (F.col("_at").isNull(), "unknown_observation"),
        (~F.coalesce(F.col("_status") == "accepted", F.lit(False)), "not_accepted"),
        ((F.col("source_id") != F.col("_source")) | (F.col("platform") != F.col("_platform")), "conflicting_stratum"), (F.col("selected_at") < F.col("_at"), "before_observation"),
    )
    judged = joined.withColumn("_broken", broken)
    firsts = judged.where("_broken IS NULL AND _stored IS NULL").groupBy(*on).agg(F.min(F.struct("selected_at", "source_id", "platform")).alias("_first"))
    own = F.struct("source_id", "platform", "selected_at")
    first = F.struct(F.col("_first.source_id").alias("source_id"), F.col("_first.platform").alias("platform"), F.col("_first.selected_at").alias("selected_at"))
    same = F.when(F.col("_stored").isNull(), F.when(own == first, F.lit("recorded"))).otherwise(F.when(own == F.col("_stored"), F.lit("replayed")))
    return judged.join(firsts, on, "left").withColumn("outcome", F.coalesce("_broken", same, F.lit("conflicting_selection"))).select(*selections.columns, "outcome")


def quarantines(findings: DataFrame, samples: DataFrame, stored: DataFrame) -> DataFrame:
    """Severe findings (finding_id, sample_id, severe, audited_at) as quarantines of their samples' observations, one each:
    (observation_id, finding_id, quarantined_at, outcome). An observation's stored finding, else its earliest (ties: least id), holds
    it: that one is `kept` or `added`, any other `conflicting`."""
    severe = findings.where("severe").join(samples.select("sample_id", "observation_id"), "sample_id")
    firsts = severe.groupBy("observation_id").agg(F.min(F.struct("audited_at", "finding_id")).alias("_first"))
    held = severe.join(stored.select("observation_id", F.col("finding_id").alias("_held")), "observation_id", "left").join(firsts, "observation_id")
    outcome = (
        F.when(F.col("_held") == F.col("finding_id"), "kept").when(F.col("_held").isNotNull(), "conflicting").when(F.col("_first.finding_id") == F.col("finding_id"), "added").otherwise("conflicting")
    )
    return held.select("observation_id", "finding_id", F.col("audited_at").alias("quarantined_at"), outcome.alias("outcome"))


def covered_fields(stored: DataFrame, evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, covered_fields, confidence): stored rows of that form, merged with pieces of evidence (keys, field, confidence): the
    sorted union of the fields and the greatest confidence. Fields are few; their sets are built on the map side."""
    pieces = stored.select(*keys, F.explode_outer("covered_fields").alias("field"), "confidence")
    return pieces.unionByName(evidence.select(*keys, "field", "confidence")).groupBy(*keys).agg(F.sort_array(F.collect_set("field")).alias("covered_fields"), F.max("confidence").alias("confidence"))


def active_requests(requests: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """For each key the earliest request that is still to be answered."""
    first = F.min_by(F.struct(*requests.columns), F.struct(*order)).alias("_r")
    return requests.where(F.col("status").isin(ACTIVE)).groupBy(*keys).agg(first).select("_r.*")


def evidence_round(members: DataFrame, observed: DataFrame, audits: DataFrame, stratum: str, key: str, failed: Column, most_failed: str) -> DataFrame:
    """What a further round of evidence would do, before it is run: per stratum its members, those observed already, those still to be
    (none where the stratum is paused: more than most_failed of its audited rows failed), and the digest of all members."""
    rate = F.count_if(failed) / F.count("*")
    paused = audits.groupBy(stratum).agg((rate > F.lit(most_failed).cast("double")).alias("_paused"))
    marked = members.join(observed.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left")
    counts = marked.groupBy(stratum).agg(F.count("*").alias("members"), F.count("_seen").alias("observed"))
    planned = counts.join(paused, stratum, "left").withColumn("paused", F.coalesce("_paused", F.lit(False))).drop("_paused")
    digest = fingerprint(members, key).select("fingerprint")  # one row
    pending = F.when(F.col("paused"), F.lit(0).cast("long")).otherwise(F.col("members") - F.col("observed"))
    return planned.withColumn("pending", pending).join(F.broadcast(digest), F.lit(True))
