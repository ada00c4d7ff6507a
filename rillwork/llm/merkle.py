"""Merkle manifest of a dataset: an external-memory store of nodes, by level, and proofs by coordinate.

Leaves are sorted into runs by (group, doc_id, leaf) and written. A node's coordinate is (group, level, place). Each
level reads the one before in coordinate order and writes families: a parent's digest with its up to FAN children.
Proofs descend from the root: a child's path is its siblings and its parent's path, joined by the parent's coordinate,
so a join key has FAN rows at most on one side and one on the other, whatever the groups' sizes.
The groups' subroots are the leaves of a second tree of the same kind, whose root is the dataset's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.llm._shared import materialize, read_table, scratch, with_default_columns

FAN = 8
FIELDS = {"doc_id": "bigint", "source": "string", "lang": "string", "n_chars": "bigint", "text": "string"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A node's siblings on one level, as text before and after it.
PATH = "array<struct<before:string,after:string>>"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(**columns: Column) -> Column:
    """The digest of a row's fields, each `-` if null, else its UTF-8 byte count, a colon and its value."""
    parts = []
    for name in FIELDS:
        value = columns.get(name, F.col(name)).cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return sha(F.concat(*parts))


def group_key(lang: Column) -> Column:
    """A key that is never null and sorts nulls first, then by UTF-8 bytes."""
    return F.when(lang.isNull(), "").otherwise(F.concat(F.lit("="), lang))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows(g, ...) -> with i, the place in its group by ``order`` from 0, and n, the group's size.

    Sorted runs are written with their partition and place; the rows of each group in each partition are counted, so
    only a row a partition and group meets in a window.
    """
    at = F.monotonically_increasing_id()
    runs = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    runs = materialize(runs.withColumn("part", F.shiftright(at, 33)).withColumn("place", at.bitwiseAND((1 << 33) - 1)), name)
    parts = runs.groupBy("g", "part").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    whole = Window.partitionBy("g")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("g", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    return runs.join(materialize(parts, f"{name}-parts"), ["g", "part"]).withColumn("i", F.col("place") + F.col("shift")).drop("part", "place", "shift")


@dataclass
class Tree:
    """``levels``: paths of tables (g, p, children, h, n), the families of each level's nodes, from the leaves up; ``tops``: (g, h, level)."""

    levels: list[DataFrame]
    tops: DataFrame


def build(leaves: DataFrame, store: str) -> Tree:
    """leaves(g, i, n, h) -> their tree, its levels written below ``store``. A group of one leaf has that as its top."""
    spark = leaves.sparkSession
    nodes, levels, tops = leaves.select("g", "i", "n", "h"), [], []
    while True:
        level = len(levels)
        tops.append(nodes.where("n = 1").select("g", "h", F.lit(level).alias("level")))
        if not (nodes.agg(F.max("n")).first()[0] or 0) > 1:
            break
        placed = nodes.where("n > 1").withColumn("p", F.expr(f"i div {FAN}"))
        read = placed.repartitionByRange("g", "p").sortWithinPartitions("g", "p", "i")
        child = F.struct("i", "h")
        families = read.groupBy("g", "p").agg(F.array_sort(F.collect_list(child)).getField("h").alias("children"), F.expr(f"ceil(first(n) / {FAN})").cast("bigint").alias("n"))
        families = families.withColumn("h", sha(F.array_join("children", ""))).sortWithinPartitions("g", "p")
        families.write.parquet(f"{store}/level={level}")
        levels.append(spark.read.schema(families.schema).parquet(f"{store}/level={level}"))
        nodes = levels[-1].select("g", F.col("p").alias("i"), "n", "h")
    every = tops[0]
    for t in tops[1:]:
        every = every.unionByName(t)
    return Tree(levels, materialize(every, "tops"))


def _children(families: DataFrame, paths: DataFrame) -> DataFrame:
    """The paths (g, i, h, path) of a level's nodes from its families and their parents' paths (g, i, path)."""
    above = paths.select("g", F.col("i").alias("p"), F.col("path").alias("above"))
    met = families.join(above.hint("merge"), ["g", "p"]).select("g", "p", "children", "above", F.posexplode("children").alias("at", "h"))
    before = F.array_join(F.slice("children", F.lit(1), F.col("at")), "")
    after = F.array_join(F.slice("children", F.col("at") + 2, F.lit(FAN)), "")
    path = F.concat(F.array(F.struct(before.alias("before"), after.alias("after"))), F.col("above"))
    return met.select("g", (F.col("p") * FAN + F.col("at")).alias("i"), "h", path.alias("path"))


def paths(tree: Tree, above: DataFrame, least: int = 0) -> DataFrame:
    """(g, i, path) of the nodes of level ``least`` from ``above`` (g, path), the paths of the trees' tops. Upper levels are written."""
    tops = tree.tops.join(above, "g").select("g", "level", F.lit(0).cast("bigint").alias("i"), "path")
    at = lambda level: tops.where(F.col("level") == level).select("g", "i", "path")
    now = at(len(tree.levels))
    for level in range(len(tree.levels) - 1, least - 1, -1):
        below = _children(tree.levels[level], now).select("g", "i", "path").unionByName(at(level))
        now = materialize(below, f"paths-{level}") if level else below
    return now


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, s: sha(F.concat(s["before"], h, s["after"])))


def siblings(path: Column) -> Column:
    """The digests of a path one after the other, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, **carried: Column) -> DataFrame:
    """docs -> (doc_id, leaf, subroot, root, path, carried): each row's leaf with its path to the root.

    Rows are grouped by lang (null first, then by bytes) and ordered in a group by doc_id (null first), ties by leaf, so rows
    that are wholly equal are neighbours and interchangeable. Missing columns count as null, others are ignored. An empty
    table has no root and gives no rows. ``carried`` columns are computed with the leaves.
    """
    spark = docs.sparkSession
    fields = with_default_columns(docs, **FIELDS)
    rows = fields.select(group_key(F.col("lang")).alias("g"), "doc_id", leaf_digest().alias("leaf"), *(c.alias(n) for n, c in carried.items()))
    leaves = materialize(numbered(rows, ["doc_id", "leaf"], "leaves"), "numbered-leaves")
    store = scratch(spark, "merkle")
    first = build(leaves.withColumnRenamed("leaf", "h"), f"{store}/groups")
    subroots = first.tops.select(F.col("g").alias("name"), F.lit("").alias("g"), "h")
    second_leaves = materialize(numbered(subroots, ["name"], "subroots"), "numbered-subroots")
    second = build(second_leaves, f"{store}/root")
    root = second.tops.select(F.lit("").alias("g"), F.lit(None).cast(PATH).alias("path")).withColumn("path", F.coalesce("path", F.array().cast(PATH)))
    top = second.tops.first()
    above = second_leaves.select("i", F.col("name"), F.col("h").alias("subroot")).join(paths(second, root).select("i", "path"), "i")
    above = materialize(above.select(F.col("name").alias("g"), "subroot", "path"), "subroot-paths")
    single = leaves.where("n = 1").join(above, "g").select("doc_id", "leaf", *carried, "subroot", "path")
    if first.levels:
        # the leaves join their families with the parents' paths, which are eight times fewer
        parents = paths(first, above.select("g", "path"), 1).select("g", F.col("i").alias("p"), "path")
        families = first.levels[0].select("g", "p", "children").join(parents.hint("merge"), ["g", "p"])
        met = leaves.where("n > 1").withColumn("p", F.expr(f"i div {FAN}")).join(families.hint("merge"), ["g", "p"])
        at = (F.col("i") % FAN).cast("int")
        own = F.struct(F.array_join(F.slice("children", F.lit(1), at), "").alias("before"), F.array_join(F.slice("children", at + 2, F.lit(FAN)), "").alias("after"))
        whole = met.select("g", "doc_id", "leaf", *carried, F.concat(F.array(own), F.col("path")).alias("path"))
        single = whole.join(F.broadcast(above.select("g", "subroot")) if _few(above) else above.select("g", "subroot"), "g").select("doc_id", "leaf", *carried, "subroot", "path").unionByName(single)
    return single.withColumn("root", F.lit(top["h"] if top else None))


def _few(groups: DataFrame, bound: int = 100_000) -> bool:
    """Whether the groups are so few that they can be broadcast (checked by counting up to the bound)."""
    return groups.limit(bound + 1).count() <= bound


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of documents.

    Where 3 divides the crc32 of the decimal doc_id (never where it is null), the folded leaf has its text's A-Z lower-cased.
    """
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(changed, leaf_digest(text=F.translate("text", UPPER, LOWER)))
    rows = manifest(read_table(spark, sf_dir, "documents"), tampered=tampered)
    out = rows.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", sha(siblings(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_tree(nodes: str, name: str, levels: int) -> list[str]:
    """Levels of a tree over ``nodes``(g, i, h), and each level's siblings; a group's only node goes up as it is."""
    out = [f"{name}0 as materialized (select g, i, h, count(*) over (partition by g) as m from {nodes})"]
    for k in range(levels):
        run = "partition by g, i // 8 order by i rows between"
        out.append(
            f"{name}p{k} as materialized (select g, i, coalesce(string_agg(h, '') over ({run} unbounded preceding and 1 preceding), '') as before, "
            f"coalesce(string_agg(h, '') over ({run} 1 following and unbounded following), '') as after from {name}{k} where m > 1)"
        )
        up = f"select g, i // 8 as i, case when any_value(m) = 1 then any_value(h) else sha256(string_agg(h, '' order by i)) end as h from {name}{k} group by g, i // 8"
        out.append(f"{name}{k + 1} as materialized (select *, count(*) over (partition by g) as m from ({up}))")
    return out


def op12_sql(levels: int = 14, upper: int = 6) -> str:
    """op12_merkle in DuckDB's SQL, for up to 8 ** levels rows of a language and 8 ** upper languages."""
    field = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar)::varchar || ':' || {c}::varchar end"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"
    byte = "list_reduce(list_concat([xor(a, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: {byte}), 4294967295)"
    parts = [
        f"d as materialized (select doc_id, coalesce('=' || lang, '') as g, {leaf('text')} as leaf, case when {crc} % 3 = 0 then {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} end as tampered from documents)",
        "l as materialized (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i from d)",
        *_sql_tree("(select g, i, leaf as h from l)", "n", levels),
        f"s as materialized (select g as name, '' as g, h, row_number() over (order by encode(g)) - 1 as i from n{levels})",
        *_sql_tree("(select g, i, h from s)", "u", upper),
        "f0 as materialized (select l.doc_id, l.leaf, l.g, l.i, s.i as j, s.h as subroot, coalesce(tampered, leaf) as cur, '' as proof from l join s on s.name = l.g)",
    ]
    steps = [(f"np{k}", f"p.g = f.g and p.i = f.i // {8**k}") for k in range(levels)] + [(f"up{k}", f"p.i = f.j // {8**k}") for k in range(upper)]
    for k, (table, on) in enumerate(steps):
        folded = "case when p.i is null then cur else sha256(before || cur || after) end as cur, proof || coalesce(before || after, '') as proof"
        parts.append(f"f{k + 1} as materialized (select f.doc_id, f.leaf, f.g, f.i, f.j, f.subroot, {folded} from f{k} f left join {table} p on {on})")
    last = f"select doc_id, leaf, subroot, u.h as root, sha256(proof) as proof_sha256, cur as folded_root, cur = u.h as verified from f{len(steps)}, u{upper} u"
    return "with " + ",\n".join(parts) + "\n" + last


OP12_SQL = op12_sql()
