"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find.

A SuperMinHash signature gives each element of a set its own permutation of the slots; an
element's value in a slot is its rank there plus a random fraction.  Ranks are dealt level by
level, and a document stops as soon as no later level can lower any slot.  Documents of equal
shingle sets are one class.  Classes that share a band of slots are candidates, unless four
bits of each slot tell that they can't be similar enough.  First each document is compared with one
leader: of its buckets' members with most company, the one that it shares most buckets with.
So a bucket of many copies costs pairs in proportion to its size.  Documents in buckets that
still hold several components are then joined by prefixes of their sets: shingles are ordered from
rare to frequent, by counts in a sketch of fixed size, and two sets that are similar enough share
one that comes early in both, so early that what follows still suffices.  Pages of one template
have their own shingles there and never meet, however many there are.  Links are confirmed on the
full sets of both texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _kit
from tidemark.llm.components import components

SLOTS, ROWS = 128, 4  # slots in a signature (a power of two), slots in a band
SKETCH = 1 << 20  # counters of the sketch of shingles' frequencies
_HIGH = np.uint64(32)


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct shingles, and where each row's begin (rows + 1).

    A shingle is a pair of 64-bit hashes, given as two arrays; a row's are sorted by the first.
    """
    starts, ends, begins = _kit.words(data, offs)
    h = _kit.span_hashes(data, starts, ends, pairs=True)
    rows = len(offs) - 1
    size = np.diff(begins)
    row = np.repeat(np.arange(rows), size)
    wide = [_kit.sequence_hashes(x, width, seed) for x, seed in zip(h, _kit.SEEDS, strict=True)]
    whole = row[: len(wide[0])] == row[width - 1 :] if len(wide[0]) else np.zeros(0, bool)
    pair, owner = [x[whole] for x in wide], row[: len(wide[0])][whole]
    short = np.flatnonzero((size > 0) & (size < width))
    if len(short):
        one = [np.array([_kit.sequence_hashes(x[begins[i] : begins[i + 1]], int(size[i]), seed)[0] for i in short], np.uint64) for x, seed in zip(h, _kit.SEEDS, strict=True)]
        pair, owner = [np.r_[x, y] for x, y in zip(pair, one, strict=True)], np.r_[owner, short]
    order = np.argsort(pair[0])
    order = order[np.argsort(owner[order].astype(np.uint16 if rows < 1 << 16 else np.int64), kind="stable")]
    (value, check), owner = (x[order] for x in pair), owner[order]
    same = np.zeros(len(value), bool)
    same[1:] = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
    if (same[1:] & (check[1:] != check[:-1])).any():  # one first hash of two shingles
        order = np.lexsort((check, value, owner))
        value, check, owner = value[order], check[order], owner[order]
        same[1:] = (value[1:] == value[:-1]) & (check[1:] == check[:-1]) & (owner[1:] == owner[:-1])
    value, check, owner = value[~same], check[~same], owner[~same]
    return value, check, np.searchsorted(owner, np.arange(rows + 1))


def _slot(value: np.ndarray, level: int, slots: int) -> np.ndarray:
    """The slot that each element's own permutation has at this level: three keyed bijections of 0 to slots - 1."""
    mask, bits, y = np.uint64(slots - 1), slots.bit_length() - 1, np.full(len(value), np.uint64(level))
    for i in range(3):
        y = (y * ((value >> np.uint64(20 * i)) | np.uint64(1)) + (value >> np.uint64(20 * i + 9))) & mask
        y ^= y >> np.uint64((bits + 1) // 2)
    return y.astype(np.int64)


def signatures(value: np.ndarray, begins: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures, a row of slots for each set; an empty set keeps the largest value."""
    rows = len(begins) - 1
    sign = np.full(rows * slots, np.iinfo(np.uint64).max)
    owner = np.repeat(np.arange(rows), np.diff(begins))
    step = np.arange(1, slots + 1, dtype=np.uint64) * _kit.ODD
    live, key = owner, _kit.mixed(value ^ np.uint64(0x5851F42D4C957F2D))
    for level in range(slots):
        if not len(live):
            break
        rank = (np.uint64(level) << _HIGH) | (_kit.mixed(key + step[level]) >> _HIGH)
        np.minimum.at(sign, live * slots + _slot(key, level, slots), rank)
        left = np.unique(live)
        open_ = np.zeros(rows, bool)
        open_[left] = sign.reshape(rows, slots)[left].max(1) >= np.uint64(level + 1) << _HIGH
        on = open_[live]
        live, key = live[on], key[on]
    return sign.reshape(rows, slots)


def features(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, fp, bands, bits) per row: size and 128-bit digest of the shingle set (null if
    empty), its band keys, and four bits of each slot."""
    source = docs.select(F.col(id_col).alias("id"), _kit.text_of(text_col).alias("text"))

    def made(batches):
        for batch in batches:
            for row, end, data, offs in _kit.slices(batch["text"]):
                value, check, begins = shingle_sets(lowered(data), offs, width)
                size = np.diff(begins)
                full = np.flatnonzero(size)
                sign = signatures(value, begins)[full]
                bands = np.empty((len(full), SLOTS // ROWS), np.uint64)
                for i in range(SLOTS // ROWS):
                    h = np.full(len(full), np.uint64(i + 1))
                    for j in range(ROWS):
                        h = _kit.mixed((h ^ sign[:, i * ROWS + j]) * _kit.ODD)
                    bands[:, i] = h
                few = _kit.mixed(sign.reshape(-1, 16)) & np.uint64(15)
                bits = (few << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64)
                fp = [hashlib.blake2b(value[a:b].tobytes() + check[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
                per = np.where(size > 0, SLOTS // ROWS, 0)
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(row, end - row), pa.array(size.astype(np.int64)), pa.array(fp, pa.binary()), _kit.ragged(bands.ravel().view(np.int64), per, pa.int64()), _kit.ragged(bits.view(np.int64), np.where(size > 0, SLOTS // 16, 0), pa.int64())],
                    ["id", "n", "fp", "bands", "bits"],
                )

    return source.mapInArrow(made, f"id {source.schema['id'].dataType.simpleString()}, n long, fp binary, bands array<long>, bits array<long>")


def sets(texts: DataFrame, width: int) -> DataFrame:
    """(id, part, n, shingles) of texts (id, text, part, n): the first of each shingle's two hashes.

    Texts whose set isn't of the size n are left out.
    """

    def made(batches):
        for batch in batches:
            for row, end, data, offs in _kit.slices(batch["text"]):
                value, _, begins = shingle_sets(lowered(data), offs, width)
                some = batch.slice(row, end - row).select(["id", "part", "n"])
                for at in range(0, end - row, 4096):
                    own = begins[at : at + 4097]
                    size = np.diff(own)
                    done = some.slice(at, len(size)).append_column("shingles", _kit.ragged(value[own[0] : own[-1]].view(np.int64), size, pa.int64()))
                    yield done.filter(pa.array(size == some["n"].slice(at, len(size)).to_numpy()))

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text", "part", "n").mapInArrow(made, f"id {kind}, part {kind}, n long, shingles array<long>")


def frequencies(own: DataFrame) -> np.ndarray:
    """In how many sets shingles are, at least, by their lowest bits: SKETCH counters, whatever the corpus."""

    def count(batches):
        seen = np.zeros(SKETCH, np.int64)
        for batch in batches:
            seen += np.bincount(batch["shingles"].flatten().to_numpy() & (SKETCH - 1), minlength=SKETCH)
        slot = np.flatnonzero(seen)
        for at in range(0, len(slot), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(slot[at : at + (1 << 16)].astype(np.int32)), pa.array(seen[slot[at : at + (1 << 16)]])], ["slot", "seen"])

    found = own.select("shingles").mapInArrow(count, "slot int, seen long").groupBy("slot").agg(F.sum("seen").alias("seen")).toArrow()
    out = np.zeros(SKETCH, np.uint32)
    out[found["slot"].to_numpy()] = np.minimum(found["seen"].to_numpy(), 0xFFFFFFFF)
    return out


def prefixes(own: DataFrame, seen: np.ndarray, percent: int) -> DataFrame:
    """(rep, part, n, pos, token): the first shingles of each set, from rare to frequent, of which a similar
    set of any size holds one; those that are surely in one set alone are left out."""
    sent = own.sparkSession.sparkContext.broadcast(seen)  # 4 MB

    def made(batches):
        seen = sent.value
        for batch in batches:
            value = batch["shingles"].flatten().to_numpy().view(np.uint64)
            size = batch["n"].to_numpy()
            owner = np.repeat(np.arange(len(size)), size)
            often = seen[(value & np.uint64(SKETCH - 1)).astype(np.int64)]
            order = np.lexsort((value, often, owner))
            pos = np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
            first = np.flatnonzero((pos < (size - (percent * size + 99) // 100 + 1)[owner]) & (often[order] > 1))
            who = pa.array(owner[first])
            yield pa.RecordBatch.from_arrays([batch["id"].take(who), batch["part"].take(who), pa.array(size[owner[first]]), pa.array(pos[first].astype(np.int32)), pa.array(value[order][first].view(np.int64))], ["rep", "part", "n", "pos", "token"])

    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(made, f"rep {kind}, part {kind}, n long, pos int, token long")


def meeting(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (rep, rep_2) of sets of different parts that share a token of their prefixes so early that
    what follows it in both suffices for the similarity.

    The smaller set's token must be in the part of its prefix that suffices for sets no smaller;
    tokens that are nowhere so early, or in one part alone, are dropped first.  The part that most
    of a token's sets are of is never joined with itself.
    """
    rows = rows.withColumn("early", F.expr(f"pos <= n - ({2 * percent} * n + {99 + percent}) div {100 + percent}"))
    each = rows.groupBy("token", "part").agg(F.count("*").alias("sets"), F.max("early").alias("early"))
    live = each.groupBy("token").agg(F.max_by("part", F.struct("sets", "part")).alias("top"), F.count("*").alias("parts"), F.sum("sets").alias("sets"), F.max("early").alias("early"))
    live = _kit.written(live.where("parts > 1 and early").select("token", "top", "sets"), "tokens")
    salt, salts = _kit.salted(live, "token", "sets")
    dealt = lambda x: x.withColumn("_dealt", F.xxhash64("rep")).withColumn("_salt", salt).drop("_dealt")
    rows = _kit.written(dealt(rows).join(live.select("token", "top", F.explode(salts).alias("_salt")), ["token", "_salt"]).drop("_salt").withColumn("main", F.col("part") == F.col("top")), "live")
    left = dealt(rows.where("early")).drop("top", "early")
    other = rows.select("token", F.explode(salts).alias("_salt"), *(F.col(c).alias(f"{c}_2") for c in ("rep", "part", "n", "pos", "main")))
    follow = F.least(F.col("n") - F.col("pos"), F.col("n_2") - F.col("pos_2"))
    fits = (F.col("part") != F.col("part_2")) & (follow * (100 + percent) >= (F.col("n") + F.col("n_2")) * percent) & (F.col("n") <= F.col("n_2"))
    pairs = lambda x, y: x.join(y, ["token", "_salt"]).where(fits).select("rep", "rep_2")
    return pairs(left.where("not main"), other).union(pairs(left.where("main"), other.where("not main_2")))


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b), with set sizes na and nb, of which 100 * intersection >= percent * union, on full sets.

    texts has (id, text).  Where an id has several texts, those count whose set has the size told.
    """
    one = looked_up(pairs, "a", texts.select(F.col("id").alias("a"), F.col("text").alias("ta")))
    both = looked_up(one, "b", texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), pairs)

    def compare(batches):
        for batch in batches:
            for row, end, data, offs in _kit.slices(batch["ta"]):
                part = batch.slice(row, end - row)
                left, lc, lb = shingle_sets(lowered(data), offs, width)
                other, at_other = _kit.raw(part["tb"])
                right, rc, rb = shingle_sets(lowered(other[at_other[0] : at_other[-1]]), at_other - at_other[0], width)
                keep = []
                for i, (na, nb) in enumerate(zip(part["na"].to_pylist(), part["nb"].to_pylist(), strict=True)):
                    x, y = slice(lb[i], lb[i + 1]), slice(rb[i], rb[i + 1])
                    _, at, to = np.intersect1d(left[x], right[y], assume_unique=True, return_indices=True)
                    n = int((lc[x][at] == rc[y][to]).sum())
                    keep.append(lb[i + 1] - lb[i] == na and rb[i + 1] - rb[i] == nb and n * 100 >= (na + nb - n) * percent)
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(compare, f"a {kind}, b {kind}").distinct()


def looked_up(pairs: DataFrame, side: str, table: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """pairs with the columns of table, which has one row for each value of side; a value that very
    many pairs have is dealt over many tasks.  counted is a written table with the rows of pairs for
    each value of side, where pairs itself would have to be made once more to count them."""
    counted = pairs if counted is None else counted
    salt, salts = _kit.salted(counted.groupBy(side).agg(F.count("*").alias("_pairs")), side, "_pairs", counted.count())
    many = pairs.withColumn("_dealt", F.xxhash64("a", "b")).withColumn("_salt", salt).drop("_dealt")
    return many.join(table.withColumn("_salt", F.explode(salts)), [side, "_salt"]).drop("_salt")


def _alike(n: Column, bits: Column, other_n: Column, other_bits: Column, percent: int) -> Column:
    """Whether two classes may reach the similarity, by sizes and by the slots' bits; three pairs in
    100,000 at the very threshold are lost to the bits."""
    chance = percent / 100 + (1 - percent / 100) / 16
    most = int(SLOTS * (1 - chance) + 4.0 * (SLOTS * chance * (1 - chance)) ** 0.5) + 1
    unlike = F.lit(0)
    for i in range(SLOTS // 16):
        z = bits[i].bitwiseXOR(other_bits[i])
        for k in (1, 2):  # the lowest of each four bits: whether any of them differs
            z = z.bitwiseOR(F.shiftrightunsigned(z, k))
        unlike = unlike + F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))
    return (F.least(n, other_n) * 100 >= F.greatest(n, other_n) * percent) & (unlike <= most)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id, kept (its id is the component's smallest).

    Shingles are ``width`` consecutive words of the text with A-Z lowered; a shorter text is one
    shingle, a null text or one without words has none and is linked with nothing.  Rows are
    linked at a Jaccard similarity of ``percent`` hundredths or more, and component_id is the
    smallest id that links reach.  Two sets at a threshold of 75 share a bucket with a probability
    of 0.999995 (32 bands of 4 slots), closer ones with a higher one.  Rows with a null id are not compared: their component_id is null and kept
    is false.  Rows that repeat id and text are one document; ids are expected to be unique
    otherwise, and rows of one id with different texts go each with its own text's component.
    Texts may be of any length.  Other columns are ignored; an empty table gives an empty result.
    """
    made = _kit.written(features(docs, id_col, text_col, width), "features")
    classes = made.where("fp is not null and id is not null").groupBy("fp", "n", "bands", "bits").agg(F.min("id").alias("rep"), F.count("*").alias("rows"))
    classes = _kit.written(classes, "classes")
    keyed = classes.select("rep", F.explode("bands").alias("band"))  # ids alone, until buckets of one are gone
    shared = _kit.written(keyed.groupBy("band").agg(F.count("*").alias("members")).where("members > 1"), "shared")
    salt, salts = _kit.salted(shared, "band", "members")
    dealt = lambda rows: rows.withColumn("_dealt", F.xxhash64("rep")).withColumn("_salt", salt).drop("_dealt")
    spread = lambda buckets: buckets.withColumn("_salt", F.explode(salts))
    in_bucket = lambda rows, buckets: dealt(rows).join(spread(buckets), ["band", "_salt"]).drop("_salt")
    member = _kit.written(in_bucket(keyed, shared), "buckets")
    company = member.groupBy("rep").agg(F.sum("members").alias("company"))
    told = _kit.written(classes.join(company, "rep").select("rep", "n", "bits", "bands", "company"), "members")
    few = _kit.written(told.select(F.col("rep").alias("id")), "ids")
    source = docs.select(F.col(id_col).alias("id"), _kit.text_of(text_col).alias("text"))
    texts = _kit.written(source.join(few, "id", "left_semi").distinct(), "texts")  # of rows in shared buckets

    def compared(pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) that are links."""
        side = lambda x: told.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
        pairs = _kit.written(pairs, "pairs")
        alike = looked_up(looked_up(pairs, "a", side("a")), "b", side("b"), pairs).where(_alike(F.col("na"), F.col("bits_a"), F.col("nb"), F.col("bits_b"), percent))
        alike = _kit.written(alike.select("a", "b", "na", "nb"), "alike")
        found = _kit.written(confirmed(alike, texts, width, percent), "links")
        _kit.dropped(pairs, alike)
        return found

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    lead = member.join(told.select("rep", "company"), "rep").groupBy("band").agg(F.max_by("rep", F.struct("company", "rep")).alias("lead"))
    led = _kit.written(in_bucket(member, lead).groupBy("lead", "rep").agg(F.count("*").alias("buckets")), "led")
    nearest = led.where("rep != lead").groupBy("rep").agg(F.max_by("lead", F.struct("buckets", "lead")).alias("lead"))
    links = compared(nearest.select(*pair("rep", "lead")).distinct())
    label = components(links)
    parts = led.join(label, F.col("rep") == F.col("node"), "left").select("lead", "rep", F.coalesce("label", "rep").alias("part"))
    apart = parts.groupBy("lead").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("lead")
    parts = looked_up(parts.withColumnsRenamed({"rep": "a", "part": "b"}), "lead", apart, led).select(F.col("a").alias("rep"), F.col("b").alias("part")).distinct()
    own = _kit.written(sets(texts.join(parts.join(told.select("rep", "n"), "rep").withColumnRenamed("rep", "id"), "id"), width), "sets")
    first = _kit.written(prefixes(own, frequencies(own), percent), "prefixes")
    more = compared(meeting(first, percent).select(*pair("rep", "rep_2")).distinct())
    label = components(more.union(label.select(F.col("label").alias("a"), F.col("node").alias("b"))))
    named = _kit.written(classes.join(label, F.col("rep") == F.col("node"), "left").select("fp", "rows", F.coalesce("label", "rep").alias("component")), "named")
    _kit.dropped(shared, member, told, few, texts, led, own, first)
    by_fp, each = _kit.salted(named, "fp", "rows")
    out = made.select("id", "n", F.when(F.col("id").isNotNull(), F.col("fp")).alias("fp"), F.xxhash64("id").alias("_dealt")).withColumn("_salt", F.coalesce(by_fp, F.lit(0)))
    out = out.join(named.select("fp", "component", F.explode(each).alias("_salt")), ["fp", "_salt"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
