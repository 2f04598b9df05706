"""The hierarchy behind tag names such as ``train/layers.3.expert_7``.

A tree is three rules on the nodes of the plain token tree:

* four or more siblings that differ in digits only get a common parent whose name
  has the digits masked;
* a node with one child, no tag of its own and no integer name on either side is
  merged with that child;
* a node with a single tag below it becomes that tag's leaf.

Each rule looks at one edge and at counts of its two ends.  So nodes are counted
once, every tag fetches the attributes of the nodes on its way from the root, and
folds its own path.  Nothing walks the tree.  A node near the root can be shared by
any number of tags, so counts are made, and fetched, per (node, slice of tags).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import digit_mask, is_integer_name, natural_key

COLLAPSE_MIN = 4  # fixed value: siblings needed for a common masked parent
MASK = "∗"  # fixed value: stands for digits in a masked name

_SLICES = 64


def _slice(c: str | Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(_SLICES))


def tokens(tags: DataFrame) -> DataFrame:
    """One row per tag and token: depth (from 1), token, the separator before it,
    and the token paths of the node and its parent."""
    parts = F.split("tag", "[/.]", -1)
    seps = F.concat(F.array(F.lit("")), F.regexp_extract_all("tag", F.lit("[/.]"), F.lit(0)))
    t = tags.select("tag").distinct().withColumns({"_t": parts, "_s": seps})
    t = t.select("tag", "_t", F.posexplode(F.arrays_zip("_t", "_s")).alias("_i", "_z"))
    path = F.array_join(F.slice("_t", 1, F.col("_i") + 1), "/")
    parent = F.when(F.col("_i") == 0, "").otherwise(F.array_join(F.slice("_t", 1, F.greatest(F.col("_i"), F.lit(1))), "/"))
    return t.select(
        "tag", (F.col("_i") + 1).alias("depth"), F.col("_z._t").alias("token"), F.col("_z._s").alias("sep"),
        path.alias("path"), parent.alias("parent"), (F.col("_i") + 1 == F.size("_t")).alias("ends"),
    )


def _node_parts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("depth", "path", "slice").agg(
        F.count(F.lit(1)).alias("n_tags"),
        F.min(F.struct("tag", "sep", "token", "parent")).alias("first"),
        F.max(F.when(F.col("ends"), F.col("tag"))).alias("own"),
    )


def _nodes(parts: DataFrame) -> DataFrame:
    """Nodes of the token tree.  The first tag, in sort order, gives the separator."""
    return (
        parts.groupBy("depth", "path")
        .agg(F.sum("n_tags").alias("n_tags"), F.min("first").alias("first"), F.max("own").alias("own"))
        .select("depth", "path", "n_tags", "own", "first.token", "first.sep", "first.parent",
                F.col("first.tag").alias("first_tag"))
        .withColumn("mask", digit_mask(F.col("token")))
    )


def _masked(nodes: DataFrame) -> DataFrame:
    """Siblings under a common mask, per slice of siblings, with the whole group's size."""
    eligible = nodes.filter((F.col("mask") != F.col("token")) & (F.col("mask") != "#"))
    parts = eligible.groupBy("depth", "parent", "mask", _slice("path").alias("slice")).agg(
        F.count(F.lit(1)).alias("siblings"), F.sum("n_tags").alias("n_tags"),
        F.min(F.struct("first_tag", "sep")).alias("first"),
    )
    groups = parts.groupBy("depth", "parent", "mask").agg(
        F.sum("siblings").alias("siblings"), F.sum("n_tags").alias("n_tags"), F.min("first").alias("first")
    )
    groups = groups.filter(F.col("siblings") >= COLLAPSE_MIN).select(
        "depth", "parent", "mask", "siblings", F.col("n_tags").alias("group_tags"),
        F.col("first.sep").alias("group_sep"),
    )
    return parts.select("depth", "parent", "mask", "slice").join(groups, ["depth", "parent", "mask"])


def numeric_groups(tags: DataFrame) -> DataFrame:
    """Masked groups: parent path, masked name, number of siblings and of tags."""
    nodes = _nodes(_node_parts(tokens(tags).withColumn("slice", _slice("tag"))))
    return _masked(nodes).select(
        "depth", "parent", F.replace("mask", F.lit("#"), F.lit(MASK)).alias("name"), "siblings",
        F.col("group_tags").alias("n_tags"),
    ).distinct()


def tag_levels(tags: DataFrame) -> DataFrame:
    """Each tag with its levels, root to leaf: ``levels`` array<struct<name, synthetic, sep>>."""
    rows = tokens(tags).withColumn("slice", _slice("tag"))
    parts = _node_parts(rows)
    nodes = _nodes(parts)
    masked = _masked(nodes)
    # Children of a node once masked siblings count as one.
    merged = masked.select("depth", "parent", "mask", "siblings").distinct()
    children = (
        nodes.select("depth", "parent", F.lit(1).cast("long").alias("c"))
        .unionByName(merged.select("depth", "parent", (1 - F.col("siblings")).alias("c")))
        .groupBy("depth", "parent").agg(F.sum("c").alias("children"))
        .select((F.col("depth") - 1).alias("depth"), F.col("parent").alias("path"), "children")
    )
    attrs = (
        nodes.withColumn("slice", _slice("path"))
        .join(masked.select("depth", "parent", "mask", "slice", "group_sep"), ["depth", "parent", "mask", "slice"], "left")
        .join(children, ["depth", "path"], "left")
        .select(
            "depth", "path", "token", F.col("sep").alias("node_sep"), "n_tags", "group_sep",
            F.when(F.col("group_sep").isNotNull(), F.replace("mask", F.lit("#"), F.lit(MASK))).alias("group_name"),
            is_integer_name(F.col("token")).alias("integer"),
            ((F.coalesce("children", F.lit(0)) == 1) & F.col("own").isNull()
             & ~is_integer_name(F.col("token"))).alias("opens"),
        )
    )
    spread = parts.select("depth", "path", "slice").join(attrs, ["depth", "path"])
    piece = F.struct("depth", "token", "node_sep", "n_tags", "group_sep", "group_name", "integer", "opens")
    chains = (
        rows.select("tag", "depth", "path", "slice").join(spread, ["depth", "path", "slice"])
        .groupBy("tag").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    )
    return chains.select("tag", F.expr(_FOLD).alias("levels"))


# Folds the nodes on a tag's way into levels.  ``prev`` is the node before; a node
# joins the level of ``prev`` when the edge between them is merged.
_FOLD = """
aggregate(
  p,
  named_struct(
    'levels', cast(array() as array<struct<name:string,synthetic:boolean,sep:string>>),
    'opens', false, 'single', false),
  (acc, v) -> named_struct(
    'levels',
    case
      when v.group_name is not null then concat(
        case when acc.opens
          then concat(slice(acc.levels, 1, size(acc.levels) - 1), array(named_struct(
                 'name', concat(element_at(acc.levels, -1).name, v.group_sep, v.group_name),
                 'synthetic', element_at(acc.levels, -1).synthetic, 'sep', element_at(acc.levels, -1).sep)))
          else concat(acc.levels, array(named_struct('name', v.group_name, 'synthetic', true, 'sep', v.group_sep)))
        end,
        array(named_struct('name', v.token, 'synthetic', false, 'sep', v.node_sep)))
      when acc.single or (acc.opens and not v.integer)
        then concat(slice(acc.levels, 1, size(acc.levels) - 1), array(named_struct(
               'name', concat(element_at(acc.levels, -1).name, v.node_sep, v.token),
               'synthetic', element_at(acc.levels, -1).synthetic, 'sep', element_at(acc.levels, -1).sep)))
      else concat(acc.levels, array(named_struct('name', v.token, 'synthetic', false, 'sep', v.node_sep)))
    end,
    'opens', v.opens, 'single', v.n_tags = 1),
  acc -> acc.levels)
"""


def tag_paths(tags: DataFrame) -> DataFrame:
    """Each tag with the path of its leaf."""
    return tag_levels(tags).select("tag", F.array_join(F.transform("levels", lambda x: x["name"]), "/").alias("path"))


def tag_tree(tags: DataFrame) -> DataFrame:
    """Nodes: path, parent, name, depth, n_tags, tag (if one ends here), synthetic, is_group."""
    names = F.transform("levels", lambda x: x["name"])
    levels = tag_levels(tags).select("tag", names.alias("_n"), F.posexplode("levels").alias("_i", "_l"))
    rows = levels.select(
        "tag", (F.col("_i") + 1).alias("depth"),
        F.array_join(F.slice("_n", 1, F.col("_i") + 1), "/").alias("path"),
        F.when(F.col("_i") == 0, "").otherwise(F.array_join(F.slice("_n", 1, F.greatest("_i", F.lit(1))), "/")).alias("parent"),
        "_l.name", "_l.synthetic", (F.col("_i") + 1 == F.size("_n")).alias("ends"),
    )
    return rows.groupBy("path", "parent", "name", "depth", "synthetic").agg(
        F.count(F.lit(1)).alias("n_tags"),
        F.max(F.when(F.col("ends"), F.col("tag"))).alias("tag"),
        F.max(~F.col("ends")).alias("is_group"),
    )


def prefix_counts(tags: DataFrame) -> DataFrame:
    """Tags below every prefix of the plain token tree."""
    return tokens(tags).groupBy("depth", "path").agg(F.count(F.lit(1)).alias("n_tags"))


def listed_children(nodes: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` children per parent, groups first, then in natural order.

    ``place`` is the position in that order and ``more`` the number of children not
    listed.  Slices are ranked first, so that a parent with very many children
    reaches a single window only with ``limit`` rows per slice.
    """
    key = [F.desc("is_group"), F.col("_key"), F.col("name"), F.col("path")]
    keyed = nodes.withColumns({"_key": natural_key(F.col("name")), "_slice": _slice("path")})
    part = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("depth", "parent", "_slice").orderBy(*key)))
    top = part.filter(F.col("_r") <= limit)
    placed = top.withColumn("place", F.row_number().over(Window.partitionBy("depth", "parent").orderBy(*key)))
    total = nodes.groupBy("depth", "parent").agg(F.count(F.lit(1)).alias("_n"))
    return (
        placed.filter(F.col("place") <= limit).join(total, ["depth", "parent"])
        .withColumn("more", F.greatest(F.col("_n") - limit, F.lit(0)))
        .drop("_key", "_slice", "_r", "_n")
    )


def selected_counts(nodes_of: DataFrame, selected: DataFrame) -> DataFrame:
    """Per node of ``nodes_of`` (path, tag rows) the number of its tags that are selected."""
    chosen = nodes_of.join(selected.select("tag").distinct(), "tag", "left_semi")
    counts = chosen.groupBy("path").agg(F.count(F.lit(1)).alias("selected"))
    total = nodes_of.groupBy("path").agg(F.count(F.lit(1)).alias("n_tags"))
    out = total.join(counts, "path", "left").withColumn("selected", F.coalesce("selected", F.lit(0)))
    state = F.when(F.col("selected") == 0, "none").when(F.col("selected") == F.col("n_tags"), "all").otherwise("some")
    return out.withColumn("state", state)


def node_tags(tags: DataFrame) -> DataFrame:
    """Rows (path, tag): every tag under each node on its way."""
    names = F.transform("levels", lambda x: x["name"])
    t = tag_levels(tags).select("tag", names.alias("_n"))
    depth = F.explode(F.sequence(F.lit(1), F.size("_n"))).alias("_d")
    return t.select("tag", "_n", depth).select(F.array_join(F.slice("_n", 1, F.col("_d")), "/").alias("path"), "tag")
