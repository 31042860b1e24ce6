import pytest

from lumenfold.config import ConfigError, overlap, parse

GOOD = """
library = "/lib"
[[sources]]
name = "a"
root = "/in/a/"
priority = 5
[[sources]]
name = "b"
root = "/in/b"
[scan]
extensions = [".JPG", ".mov"]
[keeper]
prefer = ["uuid_name"]
overrides = { b = 3 }
[imports]
directories = { a = "From A" }
template = "{year}/{month}/{original_name}"
"""


def test_settings():
    c = parse(GOOD)
    assert [(s.name, s.root, s.priority) for s in c.sources] == [("a", "/in/a", 5), ("b", "/in/b", 0)]
    assert c.scan.extensions == (".jpg", ".mov") and c.prefer == ("uuid_name",) and c.overrides == {"b": 3} and c.directories == {"a": "From A"}
    assert parse('library = "/x"').sources == ()


@pytest.mark.parametrize(
    "change, said",
    [
        (("/in/b", "/in/a/deep"), "overlap"), (("/lib", "/in"), "overlaps the library"), (('name = "b"', 'name = "a"'), "named twice"), (("priority = 5", "priority = -1"), "priority"),
        ((".mov", "mov"), "without a point"), (("uuid_name", "beauty"), "no preference"), (("{ b = 3 }", "{ z = 3 }"), "no source z"), (('"From A"', '"../up"'), "no safe relative"),
        (("{month}", "{moon}"), "no field moon"), (("[scan]", "[scam]"), "unknown section"), (("extensions =", "extents ="), "unknown setting"), (('library = "/lib"', "library ="), "no TOML"),
    ],
)
def test_what_is_wrong(change, said):
    with pytest.raises(ConfigError, match=said):
        parse(GOOD.replace(*change))


def test_overlap():
    assert overlap("/a", "/a/b") and overlap("/a/b", "/a") and overlap("/a", "/a") and not overlap("/a", "/ab")
