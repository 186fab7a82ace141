"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text is cut, without loss, into sections (after blank lines), these into paragraphs (after line ends), these into pieces
of up to five words (a sentence end closes a piece). A paragraph's node is the SHA-256 of its text, a section's that of
its paragraphs' digests, the root's that of its sections' digests: equal roots mean equal texts, and differing branches
locate edits. Pieces have short codes: likeness counts the leaves of branches that two trees share as a whole, and only
below the branches that differ compares codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.shared import bound, text_of, written

SECTION_END = r"(?<=\n\n)"
PARAGRAPH_END = r"(?<=\n)"
PIECE = r"\s*(?:\S*[^\s.!?]\s+){0,4}\S+\s*|\s+"
#: Bits of a piece's code (6 hex digits), and hex digits of a paragraph's and a section's digest in the fingerprint string.
CODE_BITS = 24
PARAGRAPH_HEX, SECTION_HEX = 10, 16
_CODE = (1 << CODE_BITS) - 1


def sections(text: Column) -> Column:
    """array<array<string>>: the paragraphs of each section; joined they give the text again."""
    return F.transform(F.split(text, SECTION_END), lambda s: F.split(s, PARAGRAPH_END))


def _codes(paragraph: Column) -> Column:
    return F.transform(F.regexp_extract_all(paragraph, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p).bitwiseAND(_CODE).cast("int"))


def tree(text: Column) -> Column:
    """struct<root, sections: array<struct<digest, paragraphs: array<struct<digest, codes: array<int>>>>>>; digests are SHA-256."""
    leaves = F.transform(sections(text), lambda ps: F.transform(ps, lambda p: F.struct(F.sha2(p, 256).alias("digest"), _codes(p).alias("codes"))))
    nodes = F.transform(leaves, lambda ps: F.struct(F.sha2(F.array_join(F.transform(ps, lambda p: p["digest"]), ""), 256).alias("digest"), ps.alias("paragraphs")))
    return bound(nodes, lambda ns: F.struct(F.sha2(F.array_join(F.transform(ns, lambda n: n["digest"]), ""), 256).alias("root"), ns.alias("sections")))


def encode(t: Column) -> Column:
    """A tree as a string: root:section/section..., a section as digest,paragraph,paragraph..., a paragraph as digest and piece codes."""
    paragraph = lambda p: F.concat(F.substring(p["digest"], 1, PARAGRAPH_HEX), F.array_join(F.transform(p["codes"], lambda c: F.lpad(F.hex(c), CODE_BITS // 4, "0")), ""))
    section = lambda s: F.concat(F.substring(s["digest"], 1, SECTION_HEX), F.lit(","), F.array_join(F.transform(s["paragraphs"], paragraph), ","))
    return F.concat(t["root"], F.lit(":"), F.array_join(F.transform(t["sections"], section), "/"))


def decode(fingerprint: Column) -> Column:
    """The tree in a fingerprint string, its section and paragraph digests cut short."""

    def paragraph(p: Column) -> Column:
        code = lambda h: F.conv(h, 16, 10).cast("int")
        return F.struct(F.substring(p, 1, PARAGRAPH_HEX).alias("digest"), F.transform(F.regexp_extract_all(F.substring(p, F.lit(PARAGRAPH_HEX + 1), F.length(p)), F.lit("[0-9A-F]{6}"), F.lit(0)), code).alias("codes"))

    def section(s: Column) -> Column:
        return bound(F.split(s, ","), lambda ps: F.struct(F.get(ps, F.lit(0)).alias("digest"), F.transform(F.slice(ps, F.lit(2), F.size(ps)), paragraph).alias("paragraphs")))

    return F.struct(F.substring_index(fingerprint, ":", 1).alias("root"), F.transform(F.split(F.substring_index(fingerprint, ":", -1), "/"), section).alias("sections"))


def leaves(t: Column) -> Column:
    """array<bigint>: the different leaves of a tree, each its piece's code below the first 40 bits of its paragraph's digest."""

    def below(p: Column) -> Column:
        branch = F.shiftleft(F.conv(F.substring(p["digest"], 1, PARAGRAPH_HEX), 16, 10).cast("bigint"), CODE_BITS)
        return bound(branch, lambda b: F.transform(p["codes"], lambda c: b.bitwiseOR(c.cast("bigint"))))

    return F.array_distinct(F.flatten(F.transform(t["sections"], lambda s: F.flatten(F.transform(s["paragraphs"], below)))))


def likeness(a: Column, b: Column) -> Column:
    """Shared leaves over all leaves of two trees, given by their leaves, 0 to 1; 1 for two without any.

    Leaves of paragraphs that both have are shared; of the others, the codes that both have.
    """
    code = lambda x: F.array_distinct(F.transform(x, lambda leaf: leaf.bitwiseAND(_CODE).cast("int")))
    apart = F.size(F.array_intersect(code(F.array_except(a, b)), code(F.array_except(b, a))))
    return bound(F.size(F.array_intersect(a, b)) + apart, lambda n: bound(F.size(a) + F.size(b) - n, lambda both: F.when(both == 0, F.lit(1.0)).otherwise(n / both)))


def differing(a: Column, b: Column) -> Column:
    """Of two trees: array<struct<section, paragraph>> (from 0) of the paragraphs of a that differ from b at their place.

    Sections of equal digests are not looked into. Trees of texts and decoded ones may not be mixed.
    """
    return F.flatten(
        F.transform(
            a["sections"],
            lambda s, i: F.when(s["digest"] == F.get(b["sections"], i)["digest"], F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
                F.filter(
                    F.transform(
                        s["paragraphs"],
                        lambda p, j: F.when(~p["digest"].eqNullSafe(F.get(F.get(b["sections"], i)["paragraphs"], j)["digest"]), F.struct(i.alias("section"), j.alias("paragraph"))),
                    ),
                    lambda x: x.isNotNull(),
                )
            ),
        )
    )


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with fingerprint (string) added or replaced. Null texts count as empty; equal texts have equal fingerprints."""
    return docs.withColumn("fingerprint", bound(tree(text_of(text_col)), encode))


#: Stands for a null id, before all others.
NULL_ID = -(1 << 63)


def next_ids(ids: DataFrame, key: str) -> DataFrame:
    """Of distinct keys: (key, next_key) in ascending order, the last followed by the first.

    Keys are dealt by ranges; each range is ordered in a window of its own, and the ranges (as many as there are
    shuffle partitions) by their ends.
    """
    ranges = written(ids.repartitionByRange(key).withColumn("pid", F.spark_partition_id()), "ranges")
    heads = ranges.groupBy("pid").agg(F.min(key).alias("head"))
    order = Window.orderBy("pid")
    first = F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("pid", F.coalesce(F.lead("head").over(order), first).alias("after"))
    inside = F.lead(key).over(Window.partitionBy("pid").orderBy(key))
    return ranges.withColumn("inside", inside).join(heads, "pid").select(key, F.coalesce("inside", "after").alias("next_key"), *[c for c in ids.columns if c != key])


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the next document's first characters replace the last quarter.

    The next document has the next larger id; the last is followed by the first. Rows of one id count as one document
    there, with the text of the least hash. Null ids count as one id below all others; null texts are empty. Every row
    gives a row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and n_edited, the
    number of paragraphs that the two trees locate as edited. Other columns of docs are not carried, whatever their names.
    An empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("k"), text_of(text_col).alias("t"))
    quarter = F.floor(F.length("t") / 4).cast("int")
    ids = rows.groupBy("k").agg(F.min(F.xxhash64("t")).alias("h"), F.max(quarter).alias("take"))
    after = next_ids(ids, "k")
    asked = after.select(F.col("next_key").alias("n_key"), F.col("k").alias("before"), F.col("take").alias("n_take"))
    chosen = after.select(F.col("k").alias("c_key"), F.col("h").alias("c_hash"))
    # The text is shuffled once, by id: both branches below read the same exchange.
    heads = (
        rows.join(asked.join(chosen, F.col("n_key") == F.col("c_key")).drop("c_key"), F.col("k") == F.col("n_key"))
        # Not an equality of both sides: as a join key it would ask for another partitioning, and another shuffle.
        .where(F.xxhash64("t").bitwiseXOR(F.col("c_hash")) == 0)
        .select("before", F.expr("substring(t, 1, n_take)").alias("piece"), bound(tree(F.col("t")), leaves).alias("next_leaves"))
        .groupBy("before")
        .agg(F.first("piece").alias("piece"), F.first("next_leaves").alias("next_leaves"))
    )
    edited = F.expr("concat(substring(t, 1, length(t) - int(floor(length(t) / 4))), substring(piece, 1, int(floor(length(t) / 4))))")
    both = rows.join(heads, F.col("k") == F.col("before")).select("k", "t", "next_leaves", edited.alias("e"))
    trees = both.select(
        F.expr(f"nullif(k, {NULL_ID})").alias(id_col),
        F.length("t").cast("bigint").alias("n_chars"),
        F.sha2("e", 256).alias("edited_sha256"),
        tree(F.col("t")).alias("own"), tree(F.col("e")).alias("edited"),
        "next_leaves",
    )
    return trees.select(
        id_col, "n_chars", "edited_sha256",
        encode(F.col("own")).alias("fingerprint"),
        encode(F.col("edited")).alias("edited_fingerprint"),
        bound(leaves(F.col("own")), lambda a: F.struct(
            bound(leaves(F.col("edited")), lambda b: likeness(a, b)).alias("near_edited"), likeness(a, F.col("next_leaves")).alias("near_next")
        )).alias("near"),
        F.size(differing(F.col("own"), F.col("edited"))).cast("bigint").alias("n_edited"),
    ).select("*", "near.*").drop("near")
