"""Line dedup by MinHash with DataFrame functions alone: of each group of similar lines of the whole corpus one line stays.

A line's signature is, for each of some orders of its character shingles' hashes, the least one; the shingles are rows, so that
one aggregate by line works out all orders, and equal lines of the corpus have one signature. Bands of the signature are bucket
keys. In a small bucket all pairs are compared by the exact Jaccard similarity of the shingles. In a larger one all lines are
compared with a line in the middle of it; those of its lines that are still in different components then meet by an exact
prefix-filter join over their rarest shingles. So no link that matters for the components is lost in a bucket, a large
family of copies costs few comparisons a line, and so do lines that are alike in common shingles only. Links become components by distributed union-find, and the first line of each
component in the order of documents stays.

Shingles have 12 characters of the lower-cased line with runs of white space as one space; a line that is shorter than a shingle
is one as a whole. With `every` they start at every place of the line, as op6_lines and the pipeline ask for. Lines are then cut
into pieces of a few places, which overlap by a shingle: a row is a piece, with a hash for each of its places. The sets that are
compared are made of the lines where pairs meet, as they take up many times the bytes of the lines.

Without `every` shingles are a sample. They start where words start and so much of the line is left and, in words longer than a
shingle, at every further place where 12 characters of the word are left; they end with four words where these have fewer
characters; and a line of seven words or fewer also has its last 12 characters. Of pairs that are similar by the shingles at every
place, these find 95 in 100 (a test holds 0.9).

Defined results: null texts have no lines and stay null; blank lines always stay; lines of one short word have one shingle;
repeated rows (same id and text) count as one document; a null id comes last in the order; other columns are carried along,
whatever their names, but columns named n_lines and n_removed, which the results replace.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_small, keep
from .components import components

SIMILAR = 0.8
SHINGLE, WORDS, BANDS, ROWS = 12, 4, 7, 3
#: Shingles at every place: so many of a line are one row; and long lines are cut into blocks first, as to look up a place takes
#: as long as the text before it.
PLACES, BLOCKS = 12, (4096, 256)
#: Words up to which a line's last characters are a shingle.
SHORT = 7
#: In buckets of so many lines all pairs are compared at once.
FEW = 32
#: So many line ids or bucket keys (16 bytes each) may be broadcast.
MOST_BROADCAST = 2_000_000
#: A line's bit map has so many words of 64 bits.
MAP_WORDS = 16
#: Orders are of so many bits of a hash.
LOW = (1 << 31) - 1


def plain(line: Column) -> Column:
    line = F.lower(line)
    # few lines have white space to replace, and a search for some bytes costs less than a pattern
    odd = reduce(Column.__or__, [F.contains(line, F.lit(c)) for c in ("  ", "\t", "\x0b", "\f", "\r")])
    return F.trim(F.when(odd, F.regexp_replace(line, r"\s+", " ")).otherwise(line))


def line_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, h, pos, spot, id, line): the lines that are not blank, plain. k and h name the document, spot (a hash) the line's
    place, and id (128 bits) its plain form."""
    cut = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    cut = cut.where(F.col("line").rlike(r"\S")).select("k", "h", "pos", F.xxhash64("k", "h", "pos").alias("spot"), plain(F.col("line")).alias("line"))
    return cut.withColumn("id", F.unhex(F.md5("line")))


def shingle_rows(lines: DataFrame, size: int = SHINGLE) -> DataFrame:
    """A row for each shingle of each plain line, with the shingle's hash h in place of the line."""
    own = [c for c in lines.columns if c != "line"]
    words = lines.select(*own, F.split("line", " ").alias("words"))
    # -1 stands for the line's last characters, which lines of few words have too
    starts = F.sequence(F.when(F.size("words") <= SHORT, -1).otherwise(0), F.size("words") - 1)
    words = words.select(*own, "words", F.explode(starts).alias("i"))
    word = lambda k: F.get("words", F.col("i") + k)  # noqa: E731  null past the end
    inside = F.when(F.octet_length(word(0)) > size, F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(word(0)) - (size - 1)))).otherwise(F.array(F.lit(1)))
    places = words.select(*own, "words", "i", F.explode(inside).alias("p"))
    ahead = F.left(F.concat_ws(" ", *map(word, range(WORDS))), F.lit(size))
    # so much of the line is left where there are enough words, else by the lengths of the last ones
    left = reduce(Column.__add__, [F.coalesce(F.char_length(word(k)) + 1, F.lit(0)) for k in range(WORDS - 1)])
    whole = word(WORDS - 1).isNotNull() | (F.col("i") <= 0) | (F.col("p") > 1) | (left > size)
    text = F.when(F.col("i") < 0, F.right(F.array_join("words", " "), F.lit(size))).when(F.col("p") == 1, ahead).otherwise(F.substring(word(0), F.col("p"), F.lit(size)))
    return places.where(whole).select(*own, F.xxhash64(text).alias("h"))


def last_start(text: Column, size: int = SHINGLE) -> Column:
    return F.greatest(F.lit(1), F.char_length(text) - (size - 1))


def piece(text: Column, start: Column, places: int, size: int = SHINGLE) -> Column:
    """What the shingles at so many places from start on are made of."""
    return F.substring(text, start, F.lit(places + size - 1))


def place_rows(lines: DataFrame, size: int = SHINGLE) -> DataFrame:
    """A row for each piece of each plain line, with the hashes h0, h1.. of its shingles in place of the line; where a piece has
    fewer of them, the last one again.

    A line of ASCII characters is looked up by its bytes, at whatever place; others are cut into blocks and pieces first."""
    own = [c for c in lines.columns if c != "line"]
    ascii_ = F.octet_length("line") == F.char_length("line")
    cut = lines.select(*own, F.when(ascii_, F.col("line").cast("binary")).alias("flat"), F.when(~ascii_, F.col("line")).alias("line"))
    for places in BLOCKS:
        starts = F.when(F.col("line").isNull() | (F.char_length("line") < places + size), F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), last_start(F.col("line"), size), F.lit(places)))
        cut = cut.select(*own, "flat", "line", F.explode(starts).alias("at")).select(*own, "flat", piece(F.col("line"), F.col("at"), places, size).alias("line"))
    cut = cut.withColumn("last", F.greatest(F.lit(1), F.coalesce(F.octet_length("flat"), F.char_length("line")) - (size - 1)))
    cut = cut.select(*own, "flat", "line", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(PLACES))).alias("at"))
    cut = cut.select(*own, "flat", "at", piece(F.col("line"), F.col("at"), PLACES, size).alias("line"), (F.col("last") - F.col("at")).alias("left"))

    def shingle(j: int) -> Column:
        at = F.least(F.lit(j), "left")
        return F.when(F.col("flat").isNotNull(), F.substring("flat", F.col("at") + at, F.lit(size))).otherwise(F.substring("line", at + 1, F.lit(size)).cast("binary"))

    return cut.select(*own, *[F.xxhash64(shingle(j)).alias(f"h{j}") for j in range(PLACES)])


def place_set(line: Column, size: int = SHINGLE) -> Column:
    """The hashes of the shingles at every place of a plain line."""

    def inside(text: Column, blocks: tuple[int, ...]) -> Column:
        if not blocks:
            return F.transform(F.sequence(F.lit(1), last_start(text, size)), lambda i: F.xxhash64(F.substring(text, i, F.lit(size))))
        starts = F.sequence(F.lit(1), last_start(text, size), F.lit(blocks[0]))
        return F.flatten(F.transform(F.transform(starts, lambda i: piece(text, i, blocks[0], size)), lambda part: inside(part, blocks[1:])))

    return F.array_distinct(inside(line, (BLOCKS[0], 64)))


def multipliers(n: int) -> list[int]:
    """Odd numbers of 31 bits that look random; each turns hashes into another order."""
    x, out = 1, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(x >> 33 | 1)
    return out


def bands(n: int = BANDS, rows: int = ROWS, hashes: tuple[str, ...] = ("h",)) -> list[Column]:
    """The bucket keys of a line, aggregates over its shingles' hashes: each of the least hashes in `rows` orders."""
    least = []
    for m in multipliers(n * rows):
        places = [(F.col(h).bitwiseAND(LOW) * m).bitwiseAND(LOW).cast("int") for h in hashes]
        least.append(F.min(F.least(*places) if len(places) > 1 else places[0]))
    return [F.xxhash64(F.lit(b), *least[b * rows : (b + 1) * rows]) for b in range(n)]


def signatures(lines: DataFrame, every: bool = False) -> DataFrame:
    """(id, bands, repeated) of each line; repeated: whether it stands in several places. lines: id, line, spot."""
    repeated = F.min("spot") < F.max("spot")
    rows, hashes = (place_rows, tuple(f"h{i}" for i in range(PLACES))) if every else (shingle_rows, ("h",))
    return rows(lines.select("id", "spot", "line")).groupBy("id").agg(F.array(*bands(hashes=hashes)).alias("bands"), repeated.alias("repeated"))


def compared(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Those pairs (a, b) whose sets have that Jaccard similarity. sets: id and set, or id and the line whose shingles at every
    place are the set."""
    of = sets.columns[1]
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col(of).alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col(of).alias("y")), "b")
    x, y = (place_set(F.col("x")), place_set(F.col("y"))) if of == "line" else (F.col("x"), F.col("y"))
    # exploded, so that sets are made once a pair and not for each use of them
    both = both.select("a", "b", F.explode(F.array(F.struct(x.alias("x"), y.alias("y")))).alias("p"))
    return both.where(alike(F.col("p.x"), F.col("p.y"), similar)).select("a", "b")


def alike(x: Column, y: Column, similar: float) -> Column:
    m, n, same = F.size(x), F.size(y), F.size(F.array_intersect(x, y))
    return F.when(F.least(m, n) >= similar * F.greatest(m, n), same >= similar * (m + n - same)).otherwise(False)


def across(rows: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) of all lines (id, component) of different components, by an exact prefix-filter join.

    A line's shingles stand in one order for all lines, the rarest first. Two similar lines have so many shingles in common that
    some shingle is among the first (1 - similar) n + 1 of both; so only lines that share one of these meet, and only where
    their sizes and the shingle's places leave room for enough in common. The work follows shared rare shingles, not the
    number of lines. A bit map has one of 1024 bits turned over for each shingle; two lines' maps differ in no more bits than the
    lines differ in shingles, so most of the lines that meet are told apart before their shingles are compared. At first one line
    of each component stands for it under a shingle; the components that this links are one, and all lines of those that are
    still different meet then. So a component of many lines meets another one by few of them where they are alike."""
    lines = rows.select("id", "component").distinct().join(sets, "id")
    lines = keep(lines if "set" in sets.columns else lines.select("id", "component", place_set(F.col("line")).alias("set")), "line-crowds")
    shingles = lines.select("id", "component", F.explode("set").alias("t"))
    often = shingles.groupBy("t").agg(F.count("*").alias("f"))
    word = F.col("t").bitwiseAND(MAP_WORDS - 1)
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(t, 32) & 63 AS int))")
    maps = [f"p{i}" for i in range(MAP_WORDS)]
    turned = [F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(p) for i, p in enumerate(maps)]
    ranked = shingles.join(often, "t").groupBy("id", "component").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("s"), *turned).withColumn("n", F.size("s"))
    width = F.col("n") - F.ceil(F.col("n") * similar - 1e-9).cast("int") + 1
    own = ["id", "component", "n", *maps]
    first = ranked.select(*own, F.posexplode(F.slice("s", F.lit(1), width)).alias("at", "x")).where("x.f > 1").select(*own, "at", "x.t")
    first = keep(first, "line-prefixes")

    def links_among(first: DataFrame) -> DataFrame:
        a, b = first.alias("l"), first.alias("r")
        two = lambda c: (F.col(f"l.{c}"), F.col(f"r.{c}"))
        (m, n), (i, j) = two("n"), two("at")
        room = F.least(m - i, n - j) >= similar / (1 + similar) * (m + n) - 1e-6
        differ = reduce(Column.__add__, [F.bit_count(two(p)[0].bitwiseXOR(two(p)[1])) for p in maps])
        near = (F.least(m, n) >= similar * F.greatest(m, n) - 1e-6) & room & (differ <= (1 - similar) / (1 + similar) * (m + n) + 1e-6)
        pairs = a.join(b.hint("merge"), (F.col("l.t") == F.col("r.t")) & (F.col("l.component") < F.col("r.component")) & near).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
        return keep(compared(keep(pairs.distinct(), "line-pairs"), lines.select("id", "set"), similar), "line-links")

    each = first.groupBy("t", "component").agg(F.min(F.struct("id", "n", "at", *maps)).alias("x")).select("t", "component", "x.*")
    links = links_among(each)
    label = lambda c: lines.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    larger = components(links.join(label("a"), "a").join(label("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    larger = keep(larger.select(F.col("id").alias("component"), F.col("component").alias("larger")), "line-groups")
    first = join_small(first, larger, ["component"], how="left", limit=MOST_BROADCAST, copies=1)
    first = first.withColumn("component", F.coalesce("larger", "component")).drop("larger")
    return links.union(links_among(first))


def similar_lines(lines: DataFrame, signed: DataFrame, similar: float = SIMILAR, every: bool = False) -> DataFrame:
    """Links (a, b) between ids of different lines whose shingles have that Jaccard similarity: all that matter for the components
    of the lines that share a bucket. lines: id, line, an id once or more; signed: their signatures, written."""
    keyed = signed.select("id", F.explode("bands").alias("key"))
    crowded = keep(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "line-keys")
    rows = keep(join_small(keyed, crowded.select("key"), ["key"], limit=MOST_BROADCAST, copies=1), "line-buckets")
    # buckets with the same lines (128 bits of a hash) are one
    same = rows.groupBy("key").agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(i), "id")).alias(f"x{i}") for i in (0, 1)])
    rows = keep(rows.join(same.groupBy("n", "x0", "x1").agg(F.min("key").alias("key")).select("key", "n"), "key"), "line-buckets")
    wanted = join_small(lines.select("id", "line"), rows.select("id").distinct(), ["id"], limit=MOST_BROADCAST, copies=1).distinct()
    sets = keep(wanted if every else shingle_rows(wanted).groupBy("id").agg(F.collect_set("h").alias("set")), "line-sets")

    small = rows.where(F.col("n") <= FEW).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    pairs = small.select("ids", F.posexplode("ids").alias("i", "a")).select("a", F.explode(F.slice("ids", F.lit(1), F.col("i"))).alias("b"))
    # a line that shares buckets with many others is likely to be in the middle of its bucket
    middle = rows.groupBy("id").agg(F.sum("n").alias("score"))
    large = keep(rows.where(F.col("n") > FEW).select("key", "id").join(middle, "id"), "line-crowds")
    pivots = large.groupBy("key").agg(F.max(F.struct("score", "id")).alias("p")).select("key", F.col("p.id").alias("b"))
    pairs = pairs.union(large.join(pivots, "key").where(F.col("id") != F.col("b")).select(F.col("id").alias("a"), "b"))
    links = keep(compared(pairs.distinct(), sets, similar), "line-links")
    if large.isEmpty():
        return links
    rows = large.select("key", "id").join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    rows = keep(rows, "line-groups")
    apart = rows.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
    return links.union(keep(across(rows.join(apart, "key"), sets, similar), "line-links"))


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", similar: float = SIMILAR, every: bool = False) -> DataFrame:
    """The columns of docs, with the text less the lines that go, and n_lines and n_removed. every: whether lines are compared by
    their shingles at every place, not by a sample."""
    lines = keep(line_table(docs, key, text), "lines")
    signed = keep(signatures(lines, every), "line-signatures")
    group = keep(components(similar_lines(lines, signed, similar, every)), "line-components")
    # only lines that stand twice or are like others can go
    members = group.union(signed.where("repeated").select("id", F.col("id").alias("component")).join(group.select("id"), "id", "left_anti"))
    members = keep(members, "line-members")
    place = F.struct(F.col("k").isNull().alias("last"), "k", "h", "pos")
    stand = keep(join_small(lines.select("id", "k", "h", "pos"), members, ["id"], limit=MOST_BROADCAST, copies=1).select("component", place.alias("place")), "line-places")
    firsts = stand.groupBy("component").agg(F.min("place").alias("stays"))
    goes = stand.join(firsts, "component").where(F.col("place") != F.col("stays")).groupBy("place.last", "place.k", "place.h").agg(F.collect_set("place.pos").alias("goes"))
    goes = goes.select(F.struct("last", F.coalesce(F.col("k").cast("string"), F.lit("")).alias("k"), "h").alias("doc"), "goes")
    name = F.struct(F.col(key).isNull().alias("last"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.xxhash64(text).alias("h"))
    rows = docs.select(F.struct("*").alias("row"), name.alias("doc")).join(goes.hint("shuffle_hash"), "doc", "left")
    body = F.col("row").getField(text)
    rows = rows.select("row", "goes", F.split(body, "\n").alias("parts"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "goes")
    kept = F.when(F.col("goes").isNull(), body).otherwise(F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n"))
    n_lines = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.size("parts"))
    n_removed = F.when(F.col("goes").isNull(), F.lit(0)).otherwise(F.size("goes"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return rows.select(*(kept.alias(text) if c == text else F.col("row").getField(c).alias(c) for c in own), n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), every=True)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))
