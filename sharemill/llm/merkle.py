"""Document fingerprints: a Merkle tree whose leaves are pieces of sentences, under paragraphs (lines)
under sections. Sections end where a paragraph's digest says so, so an edit moves none but its own.
Roots test equality; branches that differ locate an edit. Built-in functions only."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import shuffle_partitions

#: A piece of a sentence: up to 48 characters, then the sentence's end if it is there.
PIECE = r"[^.!?]{1,48}[.!?]*|[.!?]+"
#: A section ends after a paragraph whose digest starts so: one in 16. Hex digits of a leaf's digest, all of
#: which go upward, and those of a leaf and of a section that the fingerprint prints.
CUT, LEAF_HEX, PRINTED_HEX, NODE_HEX = "0", 32, 8, 16
#: Bytes of text to a range of documents, ranges at most, which bounds what is broadcast, and the parts
#: (by a digest of the text) of a range that one id fills.
RANGE_BYTES, MOST_RANGES, PARTS_HEX = 64 << 20, 1 << 16, 3
#: Parts of an id for each range that it fills, and ranges to a task.
HOT_PARTS, SPREAD = 4, 8


def paragraphs(text: Column) -> Column:
    """Each line as the hashes of its pieces, one after the other."""
    leaf = lambda p: F.md5(p.cast("binary"))
    return F.transform(F.split(text, "\n"), lambda line: F.array_join(F.transform(F.regexp_extract_all(line, F.lit(PIECE), F.lit(0)), leaf), ""))


def with_sections(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds the text's sections: each a string of its paragraphs, with commas between them. What is read
    again and again within a function over elements is a column first, so it is made once."""
    keep, lines = [c for c in df.columns if c != out], F.col("__lines")
    own = df.withColumn("__lines", paragraphs(F.col(text_col)))
    ends = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (i == F.size(lines)) | F.sha2(F.get(lines, i - 1).cast("binary"), 256).startswith(CUT))
    own = own.withColumn("__ends", ends)
    starts = F.concat(F.array(F.lit(1)), F.transform(F.slice("__ends", F.lit(1), F.size("__ends") - 1), lambda e: e + 1))
    return own.select(*keep, F.zip_with(starts, F.col("__ends"), lambda a, b: F.array_join(F.slice(lines, a, b - a + 1), ",")).alias(out))


def nodes(section_list: Column) -> Column:
    """The digest of each section: of its paragraphs' digests."""
    return F.transform(section_list, lambda s: F.sha2(F.array_join(F.transform(F.split(s, ","), lambda p: F.sha2(p.cast("binary"), 256)), "").cast("binary"), 256))


def fingerprint(section_list: Column, node_list: Column) -> Column:
    """root:section nodes:leaves, with commas between paragraphs and semicolons between sections. The root
    is of whole digests; leaves and nodes are printed short."""
    root = F.sha2(F.array_join(node_list, "").cast("binary"), 256)
    heads = F.array_join(F.transform(node_list, lambda s: F.substring(s, 1, NODE_HEX)), "")
    leaves = F.regexp_replace(F.array_join(section_list, ";"), f"([0-9a-f]{{{PRINTED_HEX}}})[0-9a-f]{{{LEAF_HEX - PRINTED_HEX}}}", "$1")
    return F.concat_ws(":", root, heads, leaves)


def _below(branches: Column, mark: str) -> Column:
    return F.array_distinct(F.split(F.array_join(branches, mark), mark))


def _leaves(lines: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.array_join(lines, ""), F.lit(f".{{{LEAF_HEX}}}"), F.lit(0)))


def _count(branches: Column) -> Column:
    """Leaves below some branches."""
    return F.length(F.regexp_replace(F.array_join(branches, ""), ",", "")) / LEAF_HEX


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds the likeness of two trees given as section lists: leaves below sections that both have, then
    below paragraphs that both have of the other sections, then leaves that both have of the other
    paragraphs, over as many of the larger tree. Branches count once; two empty trees are alike."""
    c, keep = F.col, df.columns
    own = df.withColumns({"_s": F.array_intersect(a, b), "_pa": _below(F.array_except(a, b), ","), "_pb": _below(F.array_except(b, a), ",")})
    own = own.withColumns({"_p": F.array_intersect("_pa", "_pb"), "_la": _leaves(F.array_except("_pa", "_pb")), "_lb": _leaves(F.array_except("_pb", "_pa"))})
    own = own.withColumn("_n", _count(c("_s")) + _count(c("_p")))
    most = c("_n") + F.greatest(F.size("_la"), F.size("_lb"))
    return own.select(*keep, F.when(most == 0, 1.0).otherwise((c("_n") + F.size(F.array_intersect("_la", "_lb"))) / most).alias(out))


def changed_sections(a: Column, b: Column) -> Column:
    """first:end:other end of the sections that an edit touched, from 0, ends exclusive, in the text's and
    the edited text's lists; empty for equal trees."""
    n, m = F.size(a), F.size(b)
    short = F.least(n, m)
    first = lambda differ: F.coalesce(F.get(F.filter(F.sequence(F.lit(0), short - 1), differ), F.lit(0)), short)
    head = first(lambda i: F.get(a, i) != F.get(b, i))
    tail = F.least(first(lambda i: F.get(a, n - 1 - i) != F.get(b, m - 1 - i)), short - head)
    place = F.concat_ws(":", head.cast("string"), (n - tail).cast("string"), (m - tail).cast("string"))
    return F.when((n == m) & (head == n), "").otherwise(place)


def trees(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds sections, nodes and fingerprint to every row; null texts are empty. Columns of these names
    are replaced."""
    own = with_sections(docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))), "__text", "sections").drop("__text")
    own = own.withColumn("nodes", nodes(F.col("sections")))
    return own.withColumn("fingerprint", fingerprint(F.col("sections"), F.col("nodes")))


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with next_text of the row that follows by doc_id (after the last: the first),
    nulls last, equal ids by the MD5 of their text.

    Rows are dealt into ranges of doc_id whose number follows from the bytes of text; a range also
    gets the first row of the next one, so no range needs another. An id that fills a range, or
    null, has ranges of its own, by its texts' digests. Rows equal in id and text share a range."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(shuffle_partitions(spark), math.ceil(size / RANGE_BYTES))
    n = min(MOST_RANGES, SPREAD * tasks)
    found = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 4 * n)).first()[0] or []
    hot = sorted({a for a, b in zip(found, found[1:], strict=False) if a == b})
    cuts = sorted({*found, *hot, *(v + 1 for v in hot)})
    digest = F.md5(F.col("text").cast("binary"))
    # an id has as many parts as ranges of rows, by HOT_PARTS: all ids together a multiple of the ranges
    ranges = Counter(found)
    many = [min(16**PARTS_HEX, HOT_PARTS * ranges[v]) for v in hot]
    mine = F.get(F.lit(many).cast("array<bigint>"), F.array_position(F.lit(hot).cast("array<bigint>"), F.col("doc_id")).cast("int") - 1)
    mine = F.when(F.col("doc_id").isNull(), 16**PARTS_HEX).otherwise(F.coalesce(mine, F.lit(1)))
    part = F.floor(F.conv(F.substring("digest", 1, PARTS_HEX), 16, 10).cast("long") * mine / 16**PARTS_HEX)
    span = _range_of(F.col("doc_id"), cuts) * 16**PARTS_HEX + part
    own = docs.select("doc_id", "text", digest.alias("digest"))
    own = own.select("*", span.alias("span"), F.lit(0).alias("copy"), F.lit(0).alias("wraps"))
    heads = own.groupBy("span").agg(F.min(F.struct("doc_id", "digest", "text")).alias("h"))  # one row a range
    spans = sorted(r[0] for r in heads.select("span").collect())  # HOT_PARTS times MOST_RANGES and one id's parts at most
    ring = spark.createDataFrame([(s, spans[k - 1], int(k == 0)) for k, s in enumerate(spans)], "at long, to long, wraps int")
    ahead = heads.join(F.broadcast(ring), F.col("span") == F.col("at")).select("h.doc_id", "h.text", "h.digest", F.col("to").alias("span"), F.lit(1).alias("copy"), "wraps")
    w = Window.partitionBy("span").orderBy("wraps", F.col("doc_id").asc_nulls_last(), "digest", "copy")
    dealt = own.unionByName(ahead).repartition(tasks, "span")
    return dealt.withColumn("next_text", F.lead("text").over(w)).where("copy = 0").select("doc_id", "text", "next_text")


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts lie at or below the key, by halving; nulls come after all."""
    steps = F.lit([1 << b for b in reversed(range(len(cuts).bit_length()))] or [1])
    at = F.lit(cuts or [0]).cast("array<bigint>")
    found = F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= len(cuts)) & (F.get(at, n + step - 1) <= key), n + step).otherwise(n))
    return F.when(key.isNull(), F.lit(len(cuts) + 1)).otherwise(found).cast("long")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, changed_sections.

    The edited text ends with the first floor(n_chars / 2) characters of the next document in
    place of as many of its own. Null texts are empty; a table of one row is its own next; rows
    with a null doc_id come last; repeated ids follow each other by their texts' MD5; an empty
    table gives no rows; extra columns are ignored."""
    both = with_next(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")))
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 2) as int))"))
    out = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    out = out.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    for text, name in (("text", "s"), ("edited", "e"), ("next_text", "x")):
        out = with_sections(out, text, name)
    out = out.select("doc_id", "n_chars", "edited_sha256", "s", "e", "x")
    out = out.withColumns({"sn": nodes(F.col("s")), "en": nodes(F.col("e"))})
    out = with_likeness(with_likeness(out, "s", "e", "near_edited"), "s", "x", "near_next")
    c = F.col
    return out.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(c("s"), c("sn")).alias("fingerprint"), fingerprint(c("e"), c("en")).alias("edited_fingerprint"),
        "near_edited", "near_next", changed_sections(c("s"), c("e")).alias("changed_sections"),
    )


def _oracle() -> str:
    lines = lambda t: f"list_transform(string_split({t}, chr(10)), lambda l: array_to_string(list_transform(regexp_extract_all(l, '{PIECE}'), lambda p: md5(p)), ''))"
    ends = lambda c: f"list_filter(generate_series(1, len({c})), lambda i: i = len({c}) OR starts_with(sha256({c}[i]), '{CUT}'))"
    cut = lambda c, n: f"list_transform(generate_series(1, len({n})), lambda k: array_to_string({c}[CASE WHEN k = 1 THEN 1 ELSE {n}[k - 1] + 1 END:{n}[k]], ','))"
    node = lambda s: f"list_transform({s}, lambda q: sha256(array_to_string(list_transform(string_split(q, ','), lambda p: sha256(p)), '')))"
    print_ = lambda s, d: f"sha256(array_to_string({d}, '')) || ':' || array_to_string(list_transform({d}, lambda q: substring(q, 1, {NODE_HEX})), '') || ':' || regexp_replace(array_to_string({s}, ';'), '([0-9a-f]{{{PRINTED_HEX}}})[0-9a-f]{{{LEAF_HEX - PRINTED_HEX}}}', '\\1', 'g')"
    minus = lambda x, y: f"list_filter(list_distinct({x}), lambda q: NOT list_contains({y}, q))"
    count = lambda b: f"length(replace(array_to_string({b}, ''), ',', '')) // {LEAF_HEX}"
    leaves = lambda b: f"list_distinct(list_transform(generate_series(1, length(array_to_string({b}, '')) // {LEAF_HEX}), lambda k: substring(array_to_string({b}, ''), (k - 1) * {LEAF_HEX} + 1, {LEAF_HEX})))"
    below = lambda b: f"list_distinct(string_split(array_to_string({b}, ','), ','))"
    ctes, near = [], {}
    for n, y in (("e", "es"), ("x", "xs")):
        ctes.append(f"p{n} AS (SELECT rid, list_intersect(list_distinct(ss), list_distinct({y})) AS c, {below(minus('ss', y))} AS a, {below(minus(y, 'ss'))} AS b FROM s)")
        ctes.append(f"l{n} AS (SELECT rid, {count('c')} + {count('list_intersect(a, b)')} AS n, {leaves(minus('a', 'b'))} AS a, {leaves(minus('b', 'a'))} AS b FROM p{n})")
        near[n] = f"(SELECT CASE WHEN n + greatest(len(a), len(b)) = 0 THEN 1.0 ELSE (n + len(list_intersect(a, b))) / CAST(n + greatest(len(a), len(b)) AS DOUBLE) END FROM l{n} WHERE l{n}.rid = s.rid)"
    head = "coalesce(list_filter(generate_series(1, least(len(ss), len(es))), lambda i: ss[i] <> es[i])[1] - 1, least(len(ss), len(es)))"
    tail = "coalesce(list_filter(generate_series(1, least(len(ss), len(es))), lambda i: ss[len(ss) + 1 - i] <> es[len(es) + 1 - i])[1] - 1, least(len(ss), len(es)))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text, row_number() OVER w AS rid FROM d WINDOW w AS (ORDER BY doc_id NULLS LAST, md5(text) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substring(text, 1, length(text) - length(text) // 2) || substring(next_text, 1, length(text) // 2) AS edited FROM n),
h AS (SELECT *, {lines('text')} AS sl, {lines('edited')} AS el, {lines('next_text')} AS xl FROM e),
k AS (SELECT *, {ends('sl')} AS sn, {ends('el')} AS en, {ends('xl')} AS xn FROM h),
s AS (SELECT *, {cut('sl', 'sn')} AS ss, {cut('el', 'en')} AS es, {cut('xl', 'xn')} AS xs FROM k),
{', '.join(ctes)},
c AS (SELECT rid, {head} AS head, {tail} AS tail FROM s)
SELECT s.doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, {print_('ss', node('ss'))} AS fingerprint, {print_('es', node('es'))} AS edited_fingerprint,
  {near['e']} AS near_edited, {near['x']} AS near_next,
  CASE WHEN len(ss) = len(es) AND head = len(ss) THEN '' ELSE concat(head, ':', len(ss) - least(tail, least(len(ss), len(es)) - head), ':', len(es) - least(tail, least(len(ss), len(es)) - head)) END AS changed_sections
FROM s JOIN c ON c.rid = s.rid
"""


ORACLE = _oracle()
