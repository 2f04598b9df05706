"""The tag tree against a sequential one built node by node."""

import random
import re

from scalarlake.operators import tagtree


def sequential_tree(tags):
    """{tag: (level names)} following the three rules one after the other."""
    root = {"name": "", "sep": "", "kids": {}, "tags": [], "tag": None}
    for tag in sorted(tags):
        pieces = re.split(r"([/.])", tag)
        node = root
        node["tags"].append(tag)
        for i in range(0, len(pieces), 2):
            name, sep = pieces[i], pieces[i - 1] if i else ""
            node = node["kids"].setdefault(name, {"name": name, "sep": sep, "kids": {}, "tags": [], "tag": None})
            node["tags"].append(tag)
        node["tag"] = tag

    def mask(node):
        for kid in list(node["kids"].values()):
            mask(kid)
        groups = {}
        for name in node["kids"]:
            m = re.sub("[0-9]+", "#", name)
            if m not in (name, "#"):
                groups.setdefault(m, []).append(name)
        for m, names in groups.items():
            if len(names) >= 4:
                kids = {n: node["kids"].pop(n) for n in names}
                first = kids[names[0]]
                node["kids"][m] = {"name": m.replace("#", tagtree.MASK), "sep": first["sep"], "kids": kids,
                                   "tags": [t for k in kids.values() for t in k["tags"]], "tag": None}

    def chain(node):
        for key, kid in list(node["kids"].items()):
            while len(kid["kids"]) == 1 and kid["tag"] is None:
                (only,) = kid["kids"].values()
                if kid["name"].isdigit() or only["name"].isdigit():
                    break
                kid = {**only, "name": kid["name"] + only["sep"] + only["name"], "sep": kid["sep"]}
            node["kids"][key] = kid
            chain(kid)

    def flat(node):
        for key, kid in list(node["kids"].items()):
            if len(kid["tags"]) == 1:
                name = kid["name"]
                while kid["kids"]:
                    (kid,) = kid["kids"].values()
                    name += kid["sep"] + kid["name"]
                node["kids"][key] = {**kid, "name": name}
            else:
                flat(kid)

    mask(root), chain(root), flat(root)
    out = {}

    def walk(node, names):
        if node["tag"] is not None:
            for t in node["tags"]:
                if not any(t in k["tags"] for k in node["kids"].values()):
                    out[t] = names
        for kid in node["kids"].values():
            walk(kid, (*names, kid["name"]))

    walk(root, ())
    return out


def random_tags(rng):
    words = ["a", "b", "w1", "w2", "w3", "w4", "w5", "0", "1", "22", "e_1_x", "e_2_x", "e_3_x", "e_4_x", "e_55_x"]
    tags = set()
    for _ in range(rng.randint(1, 25)):
        tag = rng.choice(words)
        for _ in range(rng.randint(0, 4)):
            tag += rng.choice("/.") + rng.choice(words)
        tags.add(tag)
    return tags


def levels_of(spark, sets):
    """All sets in one plan: every set is put under its own top level of a plain tree."""
    out = []
    for tags in sets:
        df = spark.createDataFrame([(t,) for t in sorted(tags)], "tag string")
        out.append({r.tag: tuple(x.name for x in r.levels) for r in tagtree.tag_levels(df).collect()})
    return out


def test_golden(spark):
    cases = {
        ("model/model.layers.0.w", "model/model.layers.1.w"): {
            "model/model.layers.0.w": ("model/model.layers", "0.w"),
            "model/model.layers.1.w": ("model/model.layers", "1.w")},
        ("a/0/w",): {"a/0/w": ("a/0/w",)},
        ("p/e_1", "p/e_2", "p/e_3"): {f"p/e_{i}": ("p", f"e_{i}") for i in (1, 2, 3)},
        ("p/1", "p/2", "p/3", "p/4"): {f"p/{i}": ("p", f"{i}") for i in (1, 2, 3, 4)},
        ("e_1", "e_2", "e_3", "e_4"): {f"e_{i}": ("e_∗", f"e_{i}") for i in (1, 2, 3, 4)},
        ("a.b", "a/b"): {"a.b": ("a.b",), "a/b": ("a.b",)},
    }
    for tags, want in cases.items():
        assert levels_of(spark, [tags])[0] == want


def test_random_sets(spark):
    rng = random.Random(7)
    sets = [random_tags(rng) for _ in range(6)]
    # Many independent sets at once: distinct letters keep them apart below the root.
    many = set()
    for k in range(60):
        many |= {f"s{chr(97 + k % 26)}{chr(97 + k // 26)}x/" + t for t in random_tags(rng)}
    for tags, got in zip([*sets, many], levels_of(spark, [*sets, many])):
        assert got == sequential_tree(tags)


def test_tree_nodes(spark):
    df = spark.createDataFrame([("loss",), ("loss/total",), ("acc/a",), ("acc/b",)], "tag string")
    got = {r.path: (r.parent, r.depth, r.n_tags, r.tag, r.is_group) for r in tagtree.tag_tree(df).collect()}
    assert got == {
        "loss": ("", 1, 2, "loss", True), "loss/total": ("loss", 2, 1, "loss/total", False),
        "acc": ("", 1, 2, None, True), "acc/a": ("acc", 2, 1, "acc/a", False), "acc/b": ("acc", 2, 1, "acc/b", False),
    }


def test_listed_children(spark):
    df = spark.createDataFrame([(f"g/{i}",) for i in range(30)] + [("g/2/x",)], "tag string")
    rows = tagtree.listed_children(tagtree.tag_tree(df), 4).filter("parent = 'g'").orderBy("place").collect()
    assert [(r.name, r.place, r.more) for r in rows] == [("2", 1, 26), ("0", 2, 26), ("1", 3, 26), ("3", 4, 26)]


def test_selected_counts(spark):
    tags = spark.createDataFrame([("a/x",), ("a/y",), ("b/x",), ("b/y",)], "tag string")
    sel = spark.createDataFrame([("a/x",), ("b/x",), ("b/y",)], "tag string")
    got = {r.path: r.state for r in tagtree.selected_counts(tagtree.node_tags(tags), sel).collect()}
    assert got == {"a": "some", "b": "all", "a/x": "all", "a/y": "none", "b/x": "all", "b/y": "all"}
