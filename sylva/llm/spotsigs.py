"""SpotSigs fingerprints, with DataFrame functions only.

Words are runs of letters and digits of the lower-cased text. Wherever an anchor (a common word of the four languages)
stands before a content word (one that is no anchor), the three of anchor, content word and the content word after it (if
one follows within ``REACH`` words, anchors being stepped over) make a spot signature. A content word with no anchor among
the two words before it is in no such chain's reach and makes a signature with the word after it, so that a stretch
without anchors is represented, too; an anchor that ends the text stands alone. What a word gives is settled by the words
near by, whatever the length of the text; the set of a text's signatures is its fingerprint. The likeness of two texts is
the Jaccard coefficient of their sets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# The anchors, by language.
ANCHORS = (
    "the of and to a in is that for it was with on by as be this are at from "
    "der die und in den von zu das sich mit auf des für ist nicht im dem ein eine als "
    "de la le et les des en un du une que est pour par dans qui sur au pas avec "
    "de la que el en y los las se del un por con no una su para es al lo"
).split()
REACH = 4
#: Hex digits of a signature's digest.
DIGITS = 8
LIKE = 0.8

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(ANCHORS))


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """df with ``out``: the distinct signatures' digests in order, joined without a separator; a text without words
    (null too) has the empty fingerprint. Each step is a projection of its own, so the arrays are built once a row."""
    w, z = f"_{out}_words", f"_{out}_content"
    df = df.withColumn(w, F.expr(f"filter(split(lower(coalesce({text_col}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), x -> x != '')"))
    df = df.withColumn(z, F.expr(f"transform({w}, x -> if(x IN ({_STOP}), null, x))"))
    after = ", ".join(f"get({z}, i + {k})" for k in range(2, REACH + 2))
    said = f"""CASE WHEN {z}[i] IS NULL THEN
          CASE WHEN i = size({w}) - 1 THEN x WHEN get({z}, i + 1) IS NOT NULL THEN concat_ws(' ', x, {z}[i + 1], coalesce({after})) END
        WHEN (i = 0 OR {z}[i - 1] IS NOT NULL) AND (i < 2 OR {z}[i - 2] IS NOT NULL) THEN concat_ws(' ', x, get({w}, i + 1)) END"""
    df = df.withColumn(out, F.expr(f"concat_ws('', sort_array(array_distinct(transform({w}, (x, i) -> left(md5({said}), {DIGITS})))))"))
    return df.drop(w, z)


def members(fingerprint: str | Column) -> Column:
    """The set behind a fingerprint."""
    return F.regexp_extract_all(fingerprint, F.lit(f".{{{DIGITS}}}"), F.lit(0))


def likeness(a: str, b: str) -> Column:
    """Jaccard coefficient of two fingerprint columns: equal ones are 1, and where one is empty it is 0; only other
    pairs are taken apart."""
    common = F.size(F.array_intersect(members(a), members(b)))
    total = (F.length(a) + F.length(b)) / DIGITS
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(common / (total - common))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, whose last quarter (rounded down) is replaced by as many code
    points from the start of the next document, or all of it; next by ascending id, the first after the last.

    Rows that repeat id and text are one document, returned for each row; texts that share an id are ordered by hash.
    A null id comes first. A null text is empty. A lone document is its own next; an empty table gives no rows.

    Places in the order come from range partitions and their counts. The text is dealt by id once; of the next
    document only the stretch that is needed travels, with its fingerprint.
    """
    none = F.lit(-(1 << 63))
    order = F.coalesce(F.col(id_col).cast("long"), none)
    # Both uses below read the same three columns, so that Spark deals the texts out once for both.
    base = docs.select(order.alias("o"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    sizes = base.select("o", "key", F.length("text").alias("n")).distinct()
    at = F.monotonically_increasing_id()
    laid = sizes.repartitionByRange("o", "key").sortWithinPartitions("o", "key")
    places = Scratch(laid.withColumn("part", F.shiftright(at, 33)).withColumn("place", at.bitwiseAND((1 << 33) - 1)), "places").df
    counts = sorted(map(tuple, places.groupBy("part").count().collect()))
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offset = F.broadcast(docs.sparkSession.createDataFrame(starts, "part long, start long"))
    ranked = places.join(offset, "part").select("o", "key", "n", (F.col("start") + F.col("place")).alias("rank"))
    before = ranked.select(((F.col("rank") + 1) % F.lit(max(total, 1))).alias("rank"), F.col("o").alias("po"), F.col("key").alias("pkey"), F.col("n").alias("pn"))
    told = base.join(ranked.join(before, "rank").select("o", "key", "n", "po", "pkey", "pn").hint("shuffle_hash"), ["o", "key"])
    heads = with_fingerprint(told.select("po", "pkey", "pn", "text"), "text", "next_fp").select(
        F.col("po").alias("o"), F.col("pkey").alias("key"), F.expr("left(text, pn div 4)").alias("head"), F.unhex("next_fp").alias("next_fp")
    )
    if docs.count() != total:
        heads = heads.groupBy("o", "key").agg(F.max(F.struct("head", "next_fp")).alias("x")).select("o", "key", "x.*")
    both = told.select("o", "key", "n", "text").join(heads.hint("shuffle_hash"), ["o", "key"])
    both = both.select(F.when(F.col("o") != none, F.col("o")).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "text", F.expr("concat(left(text, n - n div 4), head)").alias("edited"), F.lower(F.hex("next_fp")).alias("next_fp"))
    both = with_fingerprint(with_fingerprint(both, "text", "fingerprint"), "edited", "edited_fingerprint")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fp").alias("near_next"),
    )


def similar(prints: DataFrame, least: float = LIKE) -> DataFrame:
    """Near-duplicate pairs among ``prints(doc_id, fingerprint)``: ``a, b, likeness`` between the smallest ids of
    distinct fingerprints, a < b, likeness >= least; each row of ``members_of`` then belongs to one of them.

    Sets are partitioned by length: lengths in geometric steps of ``least``, so that partners lie in the same or the
    next partition. Within one, sets meet on a signature of their prefixes (rarest first, ties by digest), as long as
    ``least`` demands; the length bound and the bound on what the rest can still share prune before sets are compared.
    Empty fingerprints link only with themselves.
    """
    sets = members_of(prints).groupBy("fingerprint").agg(F.min("class_id").alias("id")).where("fingerprint != ''")
    sets = Scratch(sets.withColumn("n", (F.length("fingerprint") / DIGITS).cast("int")), "sets").df
    spread = sets.select("id", "n", F.explode(members("fingerprint")).alias("sig"))
    rare = spread.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = spread.join(rare, "sig").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("sigs"))
    prefix = F.slice("sigs", 1, (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))
    step = (F.log("n") / math.log(1 / least)).cast("int")
    spots = ranked.select("id", "n", step.alias("part"), F.posexplode(prefix).alias("pos", "s")).where("s.df > 1").select("id", "n", "part", "pos", F.col("s.sig").alias("sig"))
    left = spots.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), "part", "sig")
    right = spots.withColumn("part", F.explode(F.array("part", F.col("part") + 1))).select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), "part", "sig")
    need = F.ceil((F.col("nx") + F.col("ny")) * least / (1 + least) - 1e-9)
    bound = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    met = left.join(right, ["part", "sig"]).where((F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x"))))
    met = met.where((F.col("ny") >= F.col("nx") * least - 1e-9) & (bound >= need)).select("x", "y").distinct()
    a = sets.select(F.col("id").alias("x"), F.col("fingerprint").alias("fx"))
    b = sets.select(F.col("id").alias("y"), F.col("fingerprint").alias("fy"))
    return met.join(a, "x").join(b, "y").withColumn("likeness", likeness("fx", "fy")).where(F.col("likeness") >= least).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "likeness")


def members_of(prints: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, class_id``: the smallest id with the same fingerprint."""
    low = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"))
    return prints.select("doc_id", "fingerprint").join(low, "fingerprint")
