"""Elements that are alike are settled once, however many there are; what is remembered is bounded."""

from millrace.functions import selectors

HTML = "<div class=job><a href='/job/{0}'>x</a><a href='/other/{0}'>y</a></div>"


def read(pages):
    found = []

    class Links(selectors.Reader):
        def opens(self, element, names):
            found.append((element.attrs.get("href"), sorted(names)))

    matcher = selectors.Matcher({"link": "div.job > a[href*='/job/']", "any": "div a"})
    settled, inner = [], matcher._settled
    matcher._settled = lambda *a: settled.append(1) or inner(*a)
    for n in range(pages):
        Links(matcher).read(HTML.format(n))
    return found, len(settled)


def test_elements_alike_are_settled_once(monkeypatch):
    found, settled = read(50)
    assert settled == 3 and found[1:3] == [("/job/0", ["any", "link"]), ("/other/0", ["any"])] and found[-1] == ("/other/49", ["any"])
    monkeypatch.setattr(selectors, "KINDS", 1)
    assert read(50)[0] == found
