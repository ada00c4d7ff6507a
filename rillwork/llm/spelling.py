"""Grouping of spelling variants: words that one inserted, deleted or replaced character turns into each other.

A word's letters, with one left out, are hashed from polynomial prefix and suffix hashes, all places of all words of a batch
at once. Words that differ by a replacement share the hash without that place (key: hash and place), and a word shares its
own hash with each one that has a letter more (key: hash). Keys are radix-partitioned by their upper bits and sorted; where
several rows share a key their strings are compared, so that equal hashes alone link nothing.

Neighbours are summed and the best of them found group by group: no pairs are listed. The words that one key can hold are
bounded by the alphabet (replacement) and by the alphabet times the length (insertion).
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm._shared import group_starts, map_batches, map_groups, materialize, read_table, with_default_columns

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: One run in so many loses a letter.
EVERY = 199
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(word: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def words(docs: DataFrame, every: int = EVERY, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """docs(doc_id, text) -> (word, n): the runs of letters of all whole texts, A-Z lower-cased, counted.

    A run whose crc32 with its doc_id (a null id: nothing before the colon) ``every`` divides loses the letter at
    crc32 % length. Null and empty texts have no runs. Words shorter or rarer than the bounds are left out.
    """
    runs = with_default_columns(docs, doc_id="bigint", text="string").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    long = runs.where(F.char_length("run") >= least_letters).select("doc_id", lower_ascii(F.col("run")).alias("run"))
    hashed = long.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    kept = hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least_letters)
    return kept.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def mixed(x: np.ndarray) -> np.ndarray:
    """The bits of 64-bit numbers spread over all places."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def deletion_keys(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, hash) of each word without each of its letters, and of the whole word with place -1; hashes modulo 2**64.

    The hash of a prefix p and a suffix s is hash(p) * BASE**len(s) + hash(s), so all places come from two running hashes.
    """
    sizes = np.array([len(w) for w in strings], np.int64)
    most = int(sizes.max(initial=0))
    letters = np.zeros((len(strings), most), np.uint64)
    inside = np.arange(most) < sizes[:, None]
    letters[inside] = np.frombuffer("".join(strings).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    power = np.ones(most + 1, np.uint64)
    for i in range(most):
        power[i + 1 : i + 2] = power[i : i + 1] * BASE
    prefix = np.zeros((len(strings), most + 1), np.uint64)
    for i in range(most):
        prefix[:, i + 1] = np.where(inside[:, i], prefix[:, i] * BASE + letters[:, i], prefix[:, i])
    suffix = np.zeros((len(strings), most + 1), np.uint64)
    for i in range(most - 1, -1, -1):
        rest = np.maximum(sizes - 1 - i, 0)
        suffix[:, i] = np.where(inside[:, i], letters[:, i] * power[rest] + suffix[:, i + 1], np.uint64(0))
    after = np.maximum(sizes[:, None] - 1 - np.arange(most), 0)
    without = prefix[:, :-1] * power[after] + suffix[:, 1:]
    word, place = np.nonzero(inside)
    whole = np.arange(len(strings))
    return np.concatenate([word, whole]), np.concatenate([place, np.full(len(strings), -1)]), np.concatenate([without[word, place], prefix[whole, sizes]])


#: Which of a key's rows a row is: a word with a letter left out (replacement), the same for insertion, a whole word.
REPLACED, LONGER, WHOLE = 0, 1, 2


def by_length(strings: list[str], cells: int = 1 << 20) -> list[np.ndarray]:
    """The words' numbers in runs of like length, whose padded letters stay below ``cells`` (or one word)."""
    sizes = np.array([len(w) for w in strings], np.int64)
    order, out, begin = np.argsort(sizes, kind="stable"), [], 0
    for j in range(1, len(order) + 1):
        if j == len(order) or (j + 1 - begin) * sizes[order[j]] > cells:
            out.append(order[begin:j])
            begin = j
    return out


def keyed(vocabulary: DataFrame) -> DataFrame:
    """(id, word, n) -> (key, kind, place, id, n). Of equal letters side by side only the first is left out for insertion."""

    def make():
        def keys(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            word, place, h = deletion_keys(strings)
            joined = np.frombuffer("".join(strings).encode("utf-32-le"), "<u4")
            begin = np.cumsum([0, *(len(w) for w in strings)])[:-1]
            rows, whole = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
            at = begin[word[rows]] + place[rows]
            first = rows[(place[rows] == 0) | (joined[at] != joined[np.maximum(at - 1, 0)])]
            salted = mixed(h + (place.astype(np.uint64) + np.uint64(2)) * np.uint64(0xD6E8FEB86659FD93))
            plain, source = mixed(h), np.concatenate([rows, first, whole])
            kind = np.repeat(np.array([REPLACED, LONGER, WHOLE], np.int8), [len(rows), len(first), len(whole)])
            return np.concatenate([salted[rows], plain[first], plain[whole]]).astype(np.int64), kind, place[source].astype(np.int32), word[source]

        def step(c: dict) -> dict:
            strings, parts = c["word"].to_pylist(), []
            for some in by_length(strings):
                key, kind, place, word = keys([strings[j] for j in some.tolist()])
                parts.append((key, kind, place, some[word]))
            key, kind, place, word = (np.concatenate(x) for x in zip(*parts, strict=True))
            return {"key": key, "kind": kind, "place": place, "id": np.asarray(c["id"])[word], "n": np.asarray(c["n"])[word]}

        return step

    return map_batches(vocabulary.select("id", "word", "n"), make, "key bigint, kind tinyint, place int, id bigint, n bigint", 1 << 18)


def _shared(c: dict) -> dict:
    """The rows whose key another row has."""
    new = group_starts([c["key"]])
    size = np.diff(np.append(new, len(c["key"])))
    rows = pa.array(np.flatnonzero(np.repeat(size, size) > 1))
    return {n: v.take(rows) for n, v in c.items()}


def _neighbours(c: dict) -> dict:
    """Of runs of rows with equal keys: (word, near, best_n, best) for each row with a neighbour by that key."""
    kinds, places, counts = (np.asarray(c[k]) for k in ("kind", "place", "n"))
    strings = c["word"].to_pylist()
    met: dict[tuple, list[int]] = {}
    for j, (g, kind, place, w) in enumerate(zip(c["key"].to_pylist(), kinds.tolist(), places.tolist(), strings, strict=True)):
        rest = w if kind == WHOLE else w[:place] + w[place + 1 :]
        met.setdefault((g, place if kind == REPLACED else -1, rest), []).append(j)
    out: tuple[list, list, list, list] = ([], [], [], [])

    def tell(j: int, near: int, best: int) -> None:
        for column, v in zip(out, (strings[j], near, int(counts[best]), strings[best]), strict=True):
            column.append(v)

    rank = lambda j: (-counts[j], strings[j])
    for (_, place, _), rows in met.items():
        if place >= 0:
            if len(rows) > 1:
                first, second = sorted(rows, key=rank)[:2]
                for j in rows:
                    tell(j, len(rows) - 1, second if j == first else first)
            continue
        whole = [j for j in rows if kinds[j] == WHOLE]
        longer = [j for j in rows if kinds[j] == LONGER]
        if whole and longer:
            tell(whole[0], len(longer), min(longer, key=rank))
            for j in longer:
                tell(j, 1, whole[0])
    return dict(zip(("word", "near", "best_n", "best"), out, strict=True))


def neighbours(vocabulary: DataFrame, radix_bits: int = 12) -> DataFrame:
    """(id, word, n), ids and words distinct -> (word, n_near, best_n, best): how many words are near, and the most frequent of them (ties: the least)."""
    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(F.shiftrightunsigned("key", 64 - radix_bits)).sortWithinPartitions("key")

    # numbers stand for the words, so that a long word's many keys are short rows; only rows that share a key get their words
    shared = materialize(map_groups(dealt(keyed(vocabulary)), ["key"], _shared, "key bigint, kind tinyint, place int, id bigint, n bigint"), "shared-keys")
    told = shared.join(vocabulary.select("id", "word"), "id").select("key", "kind", "place", "word", "n")
    found = map_groups(dealt(told), ["key"], _neighbours, "word string, near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best"))


def variants(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n), words distinct -> (word, form, root, n, n_near, form_n).

    ``form`` is the most frequent near word (ties: the least in code-point order) if it is at least ``ratio`` times as frequent, else null; ``root``
    is where the forms lead. Each form is ``ratio`` times as frequent as the one before, so chains are short and have no
    cycles; doubling follows them in the logarithm of their length. An empty vocabulary gives an empty result.
    """
    vocabulary = materialize(vocabulary.withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    near = vocabulary.join(neighbours(vocabulary), "word", "left")
    told = F.col("best_n") >= F.lit(ratio) * F.col("n")
    rows = near.select("word", F.when(told, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(told, F.col("best_n")).alias("form_n"))
    rows = materialize(rows, "forms")
    leads = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = leads.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = materialize(leads.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        leads = met.select("word", "root")
        if met.where("moved").limit(1).count() == 0:
            break
    out = rows.join(leads, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of documents."""
    return variants(words(read_table(spark, sf_dir, "documents")))


def _crc_table() -> list[int]:
    """The 256 steps of the checksum by its rule, for SQL."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def op13_sql() -> str:
    """op13_spelling in DuckDB's SQL. Letters of runs are below code point 256, so their UTF-8 bytes are one or two."""
    table = "([" + ", ".join(map(str, _crc_table())) + "]::bigint[])"
    code = "unicode(c)::bigint"
    octets = f"flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda c: case when {code} < 128 then [{code}] else [192 + ({code} >> 6), 128 + ({code} & 63)] end))"
    crc = f"xor(list_reduce(list_concat([4294967295::bigint], {octets}), lambda a, b: xor(a >> 8, {table}[1 + (xor(a, b) & 255)])), 4294967295)"
    return f"""with recursive found as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), '{UPPER}', '{LOWER}') as run from documents),
runs as materialized (select doc_id, run, count(*) as k from found where length(run) >= {LEAST_LETTERS} group by all),
hashed as materialized (select run, k, {crc} as h from runs),
cut as (select case when h % {EVERY} = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k from hashed),
v as materialized (select word, sum(k)::bigint as n from cut where length(word) >= {LEAST_LETTERS} group by word having sum(k) >= {LEAST_COUNT}),
rest as materialized (select word, n, i, left(word, i::int) || substr(word, i::int + 2) as s from v, lateral (select unnest(range(length(word))) as i)),
near as materialized (select a.word, b.word as other, b.n as m from rest a join rest b on a.i = b.i and a.s = b.s and a.word <> b.word
  union select a.word, v.word, v.n from rest a join v on v.word = a.s union select v.word, a.word, a.n from rest a join v on v.word = a.s),
best as (select word, count(*) as n_near, first(other order by m desc, encode(other)) as best, max(m) as m from near group by word),
forms as materialized (select v.word, v.n, coalesce(n_near, 0) as n_near, case when m >= {RATIO} * v.n then best end as form, case when m >= {RATIO} * v.n then m end as form_n from v left join best using (word)),
walk(word, here) as (select word, word from v union all select walk.word, f.form from walk join forms f on f.word = walk.here where f.form is not null),
roots as (select walk.word, walk.here as root from walk join forms f on f.word = walk.here where f.form is null)
select word, form, root, n, n_near, form_n from forms join roots using (word)"""


OP13_SQL = op13_sql()
