"""Spelling variants: words that differ by one code point, from pairs of trie nodes.

Words are counted over all texts. The nodes of the trie of the frequent words, and those of the trie of the same words
read backwards, are numbered; a word of L code points is then a row of L + 1 prefix nodes and one of L + 1 suffix nodes.
A pair (prefix node, suffix node) names a split of a word: with one code point skipped between the two (L pairs) or with
none (L + 1 pairs). Words that meet in a skipping pair differ by a replacement there; a word whose skipping pair is another's
plain pair has one more code point. So an exact join of integer pairs finds all neighbours, and no distance is computed.
A pair holds one word for each code point that can stand in the gap, and one word without it at most, so groups are
small whatever the data; links are never listed, each word gets the number of its neighbours and the best of them by pair.

Tries are numbered in range partitions of the sorted words. A node that several partitions share is a prefix of the first
or last word of each of them; those nodes, a few for each partition, are numbered on the driver, all others where they are.

A variant's form is its most frequent neighbour, if that is `ratio` times as frequent; forms lead to forms, each more
frequent than the last, until a root.

Defined results: null and empty texts have no words; a null id counts as the empty text in the damage rule; ties go to the
smaller word; repeated rows count as often as they are there; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, discard, documents, materialize

#: Code points that make a word; the span from À to ÿ is taken whole.
RUN = "[A-Za-zÀ-ÿ]+"
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: The query's damage: where this divides the checksum of id and word, the word loses a code point.
DAMAGE = 199
#: Distinct words that a task counts before it sends them on.
HELD = 400_000


def damaged(id_text: str, word: str, every: int | None) -> str:
    h = zlib.crc32(f"{id_text}:{word}".encode()) if every else 1
    if not every or h % every:
        return word
    return word[: h % len(word)] + word[h % len(word) + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int | None = None) -> DataFrame:
    """(word, n) of all texts, only A to Z lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, n = re.compile(RUN).findall, Counter()
        send = lambda: pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])
        for part in byte_slices(batches, 1):
            for i, text in zip(part.column(0).to_pylist(), part.column(1)):
                own: Counter = Counter()
                for run_, k in Counter(find(text.as_py() or "")).items():
                    own[run_.translate(_LOWER)] += k
                for word, k in own.items():
                    n[damaged(i, word, damage)] += k
            if len(n) > HELD:
                yield send()
                n.clear()
        yield send()

    texts = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("word != ''")


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


def path_numbers(words: list[str], first_free: int, first: tuple[str, list[int]], last: tuple[str, list[int]]) -> list[list[int]]:
    """The trie nodes on the path of each of the sorted words, from the root's on. Prefixes of the two border words have
    their numbers; others take the next free one where they first occur."""
    out, path, before, free = [], [], "", first_free
    for w in words:
        keep = _shared(w, before) if path else -1
        path = path[: keep + 1]
        (a, a_ids), (b, b_ids) = first, last
        from_a, from_b = _shared(w, a), _shared(w, b)
        for depth in range(keep + 1, len(w) + 1):
            if depth <= from_a:
                path.append(a_ids[depth])
            elif depth <= from_b:
                path.append(b_ids[depth])
            else:
                path.append(free)
                free += 1
        out.append(path)
        before = w
    return out


def number_nodes(words: DataFrame, key: str, out: str) -> DataFrame:
    """words with the column `out`: numbers of the trie nodes of the prefixes of `key`, distinct strings, by length."""
    ordered = materialize(words.repartitionByRange(key).withColumn("part", F.spark_partition_id()), "trie")
    # One row for each partition, whatever the number of words.
    edges = ordered.groupBy("part").agg(F.min(key).alias("a"), F.max(key).alias("b"), F.sum(F.length(key).cast("long")).alias("nodes")).orderBy("part").collect()
    known: dict[str, int] = {}
    for e in edges:
        for border in (e["a"], e["b"]):
            for depth in range(len(border) + 1):
                known.setdefault(border[:depth], len(known))
    free, borders = len(known), {}
    for e in edges:
        path = lambda w: (w, [known[w[:depth]] for depth in range(len(w) + 1)])
        borders[e["part"]] = (free, path(e["a"]), path(e["b"]))
        free += e["nodes"]

    def number(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        found = path_numbers(table.column(key).to_pylist(), *borders[table.column("part")[0].as_py()]) if table.num_rows else []
        return table.drop_columns(["part"]).append_column(out, pa.array(found, pa.list_(pa.int64())))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields)
    return ordered.groupBy("part").applyInArrow(number, f"{schema}, `{out}` array<bigint>")


def node_pairs(words: DataFrame) -> DataFrame:
    """(word, n) -> rows (prefix node, suffix node, word, n, skips, first of its run): all splits of every word."""
    forward = number_nodes(words.select("word", "n"), "word", "heads")
    both = number_nodes(forward.withColumn("back", F.reverse("word")), "back", "tails")
    size = F.length("word")

    def split(at: Column, skip: int) -> Column:
        lead = (at == 0) | (F.substring("word", at + 1, F.lit(1)) != F.substring("word", at, F.lit(1))) if skip else F.lit(False)
        return F.struct(F.get("heads", at).alias("head"), F.get("tails", size - at - skip).alias("tail"), F.lit(bool(skip)).alias("skips"), lead.alias("lead"))

    skipping = F.transform(F.sequence(F.lit(0), size - 1), lambda at: split(at, 1))
    plain = F.transform(F.sequence(F.lit(0), size), lambda at: split(at, 0))
    return both.where(size > 0).select("word", "n", F.explode(F.concat(skipping, plain)).alias("s")).select("s.*", "word", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n) -> (word, n_near, best struct(less, word)) of the words that have neighbours; less is minus the count.

    Deleting any code point of a run of equal ones gives the same word, so only its first place stands for it."""
    # At most one word without the gap and one for each code point in it: groups do not grow with the data.
    member = F.struct((-F.col("n")).alias("less"), "word", "skips", "lead")
    groups = node_pairs(words).groupBy("head", "tail").agg(F.array_sort(F.collect_list(member)).alias("members")).where(F.size("members") > 1)

    def met(x: Column) -> Column:
        near = F.filter("members", lambda y: (y["word"] != x["word"]) & F.when(~x["skips"], y["lead"]).when(~y["skips"], x["lead"]).otherwise(True))
        return F.struct(x["word"].alias("word"), F.transform(near, lambda y: F.struct(y["less"].alias("less"), y["word"].alias("word"))).alias("near"))

    each = groups.select(F.explode(F.transform("members", met)).alias("m")).where(F.size("m.near") > 0)
    each = each.select(F.col("m.word").alias("word"), F.size("m.near").cast("long").alias("k"), F.get("m.near", F.lit(0)).alias("first"))
    return each.groupBy("word").agg(F.sum("k").alias("n_near"), F.min("first").alias("best"))


def roots(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """(word, form) -> (word, root). Along forms counts grow by `ratio`, so a chain has some log(most) steps at most, and
    jumping over twice as many with every round needs few rounds."""
    steps = max(1, math.ceil(math.log(max(most, ratio), ratio)) + 1)
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(steps)) + 1):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        discard(now)
        now = after
    return now


def spelling_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n), distinct words -> word, n, form, root, n_near, form_n."""
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants: ratio is 2 at least")
    words = materialize(words.select("word", "n"), "words")
    near = words.join(neighbours(words), "word", "left")
    taken = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    held = materialize(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")), "forms")
    forms = held.where("form is not null")
    most = forms.agg(F.max("form_n")).first()[0] or 1
    return held.join(roots(forms, most, ratio), "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def op12_spelling_trie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents with its neighbours, form and root."""
    counted = word_counts(documents(spark, sf_dir), damage=DAMAGE)
    return spelling_groups(counted.where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT)))


OP12_SQL = f"""WITH RECURSIVE
crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL),
hexed AS (SELECT *, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS x FROM own),
summed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda j: CAST('0x' || x[j:j + 1] AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM hexed, crc),
words AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n FROM summed GROUP BY 1 HAVING sum(k) >= {LEAST_COUNT}),
dict AS (SELECT * FROM words WHERE length(word) >= {LEAST_LENGTH}),
skips AS (SELECT word, n, left(word, CAST(i AS INT)) AS head, substr(word, CAST(i AS INT) + 2) AS tail, i = 0 OR word[i] <> word[i + 1] AS lead FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM dict) s0),
gaps AS (SELECT word, n, left(word, CAST(i AS INT)) AS head, substr(word, CAST(i AS INT) + 1) AS tail FROM (SELECT word, n, unnest(range(0, length(word) + 1)) AS i FROM dict) g0),
links AS (SELECT a.word, b.word AS near, b.n FROM skips a JOIN skips b USING (head, tail) WHERE a.word <> b.word
 UNION ALL SELECT a.word, b.word, b.n FROM skips a JOIN gaps b USING (head, tail) WHERE a.lead
 UNION ALL SELECT b.word, a.word, a.n FROM skips a JOIN gaps b USING (head, tail) WHERE a.lead),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS n_best FROM links GROUP BY word),
formed AS (SELECT d.word, d.n, coalesce(n_near, 0) AS n_near, CASE WHEN n_best >= {RATIO} * d.n THEN near END AS form, CASE WHEN n_best >= {RATIO} * d.n THEN n_best END AS form_n FROM dict d LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.form, c.at AS root, f.n_near, f.form_n FROM formed f JOIN chain c USING (word) JOIN formed e ON e.word = c.at WHERE e.form IS NULL"""
