"""Line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity.

A line in lower case, with all but letters and digits as single spaces, is its
normal form. Normal forms get a SimHash of their distinct words. Distinct
SimHashes meet in buckets of every choice of some of their blocks of bits: by
the pigeonhole principle all that differ in at most DISTANCE bits do. Those
that meet and differ in at most LOOSE bits are compared, and linked if their
edit similarity reaches PERCENT.

A bucket of more than CAP values is dealt again by quarters of the bits that its
values do not share yet, of which one must be equal within DISTANCE. Each value
is compared with the first near one of its bucket; after that, buckets whose
values are all connected are done, and in the others only values that are not
connected yet are compared: while these are many, one pair of values for two
groups that meet, drawn anew in each round, and then all that are left. What is crowded even when dealt again, and forms that
share one SimHash in great number, are compared with leaders first. So all
pairs within DISTANCE are either compared or connected by others. Of each
connected group of forms one occurrence stays, the first by doc_id and line.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._groups import components, groups
from ._io import table
from ._scratch import Scratch, bounded_bytes, join_counted, setting

DISTANCE = 3
LOOSE = 6
PERCENT = 80
#: Values of a bucket that are compared pair by pair; larger ones are dealt again.
CAP = 128
#: How often a crowded bucket is dealt again.
REFINED = 3
#: Rounds in which pairs of groups that may be linked are tried by one pair of values, and pairs for each value, or at all, that are compared without another round.
ROUNDS = 4
AT_ONCE = 1
FEW_PAIRS = 50_000
#: Values for each possible bucket from which on more blocks are used.
FILL = 8
#: Words whose hashes are added up bit by bit in columns; more are added up in lanes of a fold, which takes far longer for a word.
COLUMNS = 191
#: Words that lanes of 8 bits can count with a bit to spare.
LANE_WORDS = 127


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def normal(text: Column) -> Column:
    """A text in lower case, with all but letters, digits and ends of lines as single spaces; a line of it, trimmed, is a normal form."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\n]++", " ")


def version_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _sums(width: int, of: Callable[[int], Column]) -> Column:
    """A struct of 64 counts in lanes of ``width`` bits: sum k holds those of bits k, k + width, ..."""
    return F.struct(*[of(k).alias(f"s{k}") for k in range(width)])


def _spread(bits: Column, k: int, width: int) -> Column:
    """Bits k, k + width, ... as lanes."""
    return F.shiftrightunsigned(bits, k).bitwiseAND(F.lit(_signed(sum(1 << at for at in range(0, 64, width)))))


def _zeros(width: int) -> Column:
    return _sums(width, lambda k: F.lit(0).cast("long"))


def _more_than_half(sums: Column, n: Column, width: int) -> Column:
    """The bits whose count is more than half of ``n`` < 2**(width - 1).

    A count is more if what half leaves of the lane makes it reach the lane's
    top bit; the last lane is compared by itself, as a sum must not overflow.
    """
    lower = sum(1 << at for at in range(0, 64 - width, width))
    half = F.shiftright(n, 1).cast("long")
    room = (F.lit((1 << (width - 1)) - 1) - half) * F.lit(lower)
    parts = []
    for k in range(width):
        counts = sums[f"s{k}"]
        inner = F.shiftrightunsigned(counts.bitwiseAND(F.lit((1 << (64 - width)) - 1)) + room, width - 1).bitwiseAND(F.lit(lower))
        last = F.when(F.shiftrightunsigned(counts, 64 - width) > half, F.lit(1 << (64 - width))).otherwise(F.lit(0).cast("long"))
        parts.append(F.shiftleft(inner.bitwiseOR(last), k))
    return reduce(Column.bitwiseOR, parts)


def _folded(hashes: Column) -> Column:
    """The SimHash of any number of hashes: lanes of 8 bits for LANE_WORDS hashes at once, and wider ones for their sums."""
    count = lambda part: F.aggregate(part, _zeros(8), lambda sums, h: _sums(8, lambda k: sums[f"s{k}"] + _spread(h, k, 8)))
    chunk = lambda i: F.slice(hashes, i * LANE_WORDS + 1, LANE_WORDS)
    wider = lambda sums, own: _sums(32, lambda k: sums[f"s{k}"] + F.shiftrightunsigned(own[f"s{k % 8}"], k - k % 8).bitwiseAND(F.lit(0xFF000000FF)))
    chunks = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / LANE_WORDS).cast("int"))
    many = F.aggregate(chunks, _zeros(32), lambda sums, i: _bound(count(chunk(i)), lambda own: wider(sums, own)), lambda sums: _more_than_half(sums, F.size(hashes), 32))
    return F.when(F.size(hashes) <= LANE_WORDS, _bound(count(hashes), lambda sums: _more_than_half(sums, F.size(hashes), 8))).otherwise(many)


def with_simhash(rows: DataFrame, words: Column) -> DataFrame:
    """``rows`` with ``simhash``: 64 bits, each set if more than half of the distinct words' hashes have it set.

    Words count once, or a few frequent ones would make long lines of one
    language alike. Up to COLUMNS hashes are added up by full adders: of three
    columns of one weight one stays, and one of twice the weight comes about,
    until there is one of each weight. Each step is a projection of its own,
    which computes a column once; the first one reads the hashes.
    """
    kept = [F.col(c) for c in rows.columns]
    rows = rows.select(*kept, F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))).alias("_h"))
    rows = rows.select(*kept, F.size("_h").alias("_n"), F.when(F.size("_h") > COLUMNS, _folded(F.col("_h"))).alias("_folded"), "_h")
    kept += [F.col("_n"), F.col("_folded")]
    weights, made = {0: [f"_0_{j}" for j in range(COLUMNS)]}, COLUMNS
    hashes = {name: F.coalesce(F.get("_h", F.lit(j)), F.lit(0).cast("long")) for j, name in enumerate(weights[0])}
    column = lambda name: hashes[name].alias(name) if name in hashes else F.col(name)  # noqa: B023, E731
    while any(len(names) > 1 for names in weights.values()):
        after: dict[int, list[str]] = {}
        columns = list(kept)
        for weight, names in weights.items():
            whole = len(names) - len(names) % 3
            pairs = [names[whole:]] if len(names) - whole == 2 else []
            for group in [names[i : i + 3] for i in range(0, whole, 3)] + pairs:
                x, y = column(group[0]), column(group[1])
                z = column(group[2]) if len(group) == 3 else F.lit(0).cast("long")
                either = x.bitwiseXOR(y)
                for at, value in ((weight, either.bitwiseXOR(z)), (weight + 1, x.bitwiseAND(y).bitwiseOR(either.bitwiseAND(z)))):
                    columns.append(value.alias(f"_{at}_{made}"))
                    after.setdefault(at, []).append(f"_{at}_{made}")
                    made += 1
            if len(names) - whole == 1:
                columns.append(column(names[-1]))
                after.setdefault(weight, []).append(names[-1])
        rows, weights, hashes = rows.select(*columns), after, {}
    half = F.shiftright("_n", 1).cast("long")
    more, equal = F.lit(0).cast("long"), F.lit(-1).cast("long")
    for weight in sorted(weights, reverse=True):
        own, limit = F.col(weights[weight][0]), -(F.shiftright(half, weight).bitwiseAND(F.lit(1)))
        more = more.bitwiseOR(equal.bitwiseAND(own).bitwiseAND(F.bitwise_not(limit)))
        equal = equal.bitwiseAND(F.bitwise_not(own.bitwiseXOR(limit)))
    return rows.select(*[c for c in kept[:-2]], F.coalesce("_folded", more).alias("simhash"))


def _occurrences(docs: DataFrame) -> DataFrame:
    """Every line with a normal form: doc_id, version, line, its hashes h1 and h2, length and SimHash."""
    texts = docs.select("doc_id", version_of(F.col("text")).alias("version"), normal(F.col("text")).alias("text"))
    rows = texts.select("doc_id", "version", F.posexplode(F.split("text", "\n", -1)).alias("line", "body"))
    rows = rows.withColumn("body", F.trim("body")).filter("body <> ''")
    hashed = rows.select("doc_id", "version", "line", F.xxhash64("body").alias("h1"), F.hash("body").alias("h2"), F.length("body").alias("length"), "body")
    return with_simhash(hashed, F.split("body", " ")).drop("body")


def _parts(at: list[int], count: int) -> list[list[int]]:
    return [at[len(at) * i // count : len(at) * (i + 1) // count] for i in range(count)]


def _masks(values: int) -> list[int]:
    """The bits that two values within DISTANCE share in one case at least, as few as fill the buckets for so many values."""
    blocks = DISTANCE + 2
    while values > FILL << (64 * (blocks - DISTANCE) // blocks):
        blocks += 1
    parts = [sum(1 << b for b in p) for p in _parts(list(range(64)), blocks)]
    return [sum(chosen) for chosen in combinations(parts, blocks - DISTANCE)]


def _refined(mask: int) -> list[int]:
    """The mask with one of the parts of the other bits: of DISTANCE + 1 parts one must be equal."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in p) for p in _parts(free, DISTANCE + 1)]


def close_values(scratch: Scratch, values: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Of distinct values (simhash) the buckets (part, bits) with near values: part, bits, simhash, first; and those that stay crowded (key, simhash).

    ``first`` is the next value of the bucket within LOOSE, null without one.
    Values that meet in crowded buckets only are in none of the first.
    """
    masks = [_masks(values.count())]
    rows = values.select("simhash", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks[0])])).alias("p"))
    found = []
    for turn in range(REFINED + 1):
        rows = rows.select((F.col("p.part") + turn * 100_000).alias("part"), F.col("simhash").bitwiseAND(F.col("p.mask")).alias("bits"), "simhash")
        bucket = W.partitionBy("bits", "part").orderBy("simhash")  # bits first: they tell most rows of a sort apart
        met = rows.select(
            "part",
            "bits",
            "simhash",
            F.count("*").over(bucket.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("size"),
            F.collect_list("simhash").over(bucket.rowsBetween(1, CAP - 1)).alias("later"),
        ).filter("size > 1")
        near = F.filter("later", lambda x: F.bit_count(x.bitwiseXOR(F.col("simhash"))) <= LOOSE)
        met = met.select("part", "bits", "simhash", "size", F.when(F.col("size") <= CAP, F.get(near, F.lit(0))).alias("first"))
        met = met.withColumn("any", F.count("first").over(W.partitionBy("bits", "part"))).filter((F.col("size") > CAP) | (F.col("any") > 0)).drop("any")
        met = scratch.keep(met, f"met{turn}")
        found.append(met.filter(F.col("size") <= CAP).drop("size"))
        crowded = met.filter(F.col("size") > CAP)
        if crowded.isEmpty():
            break
        if turn == REFINED:
            return reduce(DataFrame.unionByName, found), crowded.select(F.xxhash64("part", "bits").alias("key"), "simhash")
        masks.append([m for mask in masks[-1] for m in _refined(mask)])
        ways = DISTANCE + 1
        finer = F.array(*[F.array(*[F.struct(F.lit(ways * i + j).alias("part"), F.lit(_signed(masks[-1][ways * i + j])).alias("mask")) for j in range(ways)]) for i in range(len(masks[-2]))])
        rows = crowded.select("simhash", F.explode(F.get(finer, F.col("part") - turn * 100_000)).alias("p"))
    return reduce(DataFrame.unionByName, found), None


def apart_values(met: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """Values (a, root) that are within LOOSE of later ones of a bucket whose ``roots`` (simhash, root) differ: ``all`` of them, and ``one`` drawn for the turn."""
    bucket = W.partitionBy("part", "bits")
    rows = met.drop("first").join(roots, "simhash").withColumns({"low": F.min("root").over(bucket), "high": F.max("root").over(bucket)}).filter("low <> high")
    later = F.collect_list(F.struct("simhash", "root")).over(bucket.orderBy("simhash").rowsBetween(1, CAP - 1))
    near = F.filter("later", lambda x: (x["root"] != F.col("root")) & (F.bit_count(x["simhash"].bitwiseXOR(F.col("simhash"))) <= LOOSE))
    rows = rows.select("simhash", "root", later.alias("later")).select(F.col("simhash").alias("a"), "root", near.alias("all")).filter(F.size("all") > 0)
    return rows.withColumn("one", F.get("all", F.pmod(F.xxhash64("a", F.lit(turn)), F.size("all")).cast("int")))


def _bodies(scratch: Scratch, docs: DataFrame, forms: DataFrame) -> DataFrame:
    """id and normal form of ``forms`` (id, place), from one place of each."""
    wanted = forms.select(F.col("place.doc_id").alias("d"), F.col("place.version").alias("v"), F.struct(F.col("place.line").alias("line"), "id").alias("at"))
    wanted = scratch.keep(wanted.groupBy("d", "v").agg(F.collect_list("at").alias("at")), "wanted")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))
    rows = docs.withColumn("version", version_of(F.col("text"))).join(bounded_bytes(wanted, 128), same)
    lines = F.split(normal(F.col("text")), "\n", -1)
    chosen = _bound(lines, lambda own: F.transform("at", lambda x: F.struct(x["id"].alias("id"), F.trim(F.get(own, x["line"])).alias("body"))))
    return rows.select(F.explode(chosen).alias("x")).select("x.*")


def alike(left: Column, right: Column) -> Column:
    """Whether two different normal forms reach PERCENT: their edits are at most the rest of 100 of the longer length.

    Words that both begin or end with cost no edit, so only what is between
    them is compared, each word with a space after it. To replace it whole, or
    word by word if there are as many, is enough where that costs so little.
    """
    most = ((100 - PERCENT) * F.greatest(F.length(left), F.length(right)) / 100).cast("int")
    same = lambda a, b: F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int") - 1
    rest = lambda words, n: F.reverse(F.slice(words, n + 1, F.size(words)))
    text = lambda words: F.when(F.size(words) > 0, F.concat(F.concat_ws(" ", words), F.lit(" "))).otherwise("")

    def turned(words: Column) -> Column:
        """Both lists backwards, without the words that both begin with."""
        counted = _bound(words, lambda w: F.struct(w["l"].alias("l"), w["r"].alias("r"), same(w["l"], w["r"]).alias("n")))
        return _bound(counted, lambda w: F.struct(rest(w["l"], w["n"]).alias("l"), rest(w["r"], w["n"]).alias("r")))

    between = turned(turned(F.struct(F.split(left, " ").alias("l"), F.split(right, " ").alias("r"))))
    replaced = lambda a, b: F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(F.greatest(F.length(x), F.length(y))))
    worded = lambda a, b: F.when(F.size(a) == F.size(b), F.aggregate(replaced(a, b), F.lit(0), lambda n, k: n + k))
    texts = _bound(between, lambda w: F.struct(text(w["l"]).alias("l"), text(w["r"]).alias("r"), worded(w["l"], w["r"]).alias("worded")))
    few = lambda t: F.least(F.greatest(F.length(t["l"]), F.length(t["r"])), t["worded"]) <= most
    return _bound(texts, lambda t: F.when(few(t), True).otherwise(F.call_function("levenshtein", t["l"], t["r"], most) >= 0))


def _length_allows(left: str, right: str) -> Column:
    a, b = F.col(f"length_{left}"), F.col(f"length_{right}")
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def links(scratch: Scratch, docs: DataFrame, forms: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids of ``forms`` (id, simhash, length, place) that connect all linked forms.

    Pairs of forms that others already connect are not all listed.
    """
    sized = scratch.keep(forms.groupBy("simhash").agg(F.count("*").alias("forms")), "sized")
    met, crowded = close_values(scratch, sized.select("simhash"))
    parts = [met.select("simhash"), sized.filter("forms > 1").select("simhash")]
    involved = scratch.keep(reduce(DataFrame.unionByName, [*parts, crowded.select("simhash")] if crowded else parts).distinct().join(sized, "simhash"), "involved")
    family = scratch.keep(forms.join(bounded_bytes(involved, 64), "simhash"), "family")
    texts = scratch.keep(_bodies(scratch, docs, family.select("id", "place")).dropDuplicates(["id"]), "bodies")
    family = family.drop("place")

    def linked(pairs: DataFrame) -> DataFrame:
        whole = pairs.join(texts.withColumnsRenamed({"id": "a", "body": "left"}), "a").join(texts.withColumnsRenamed({"id": "b", "body": "right"}), "b")
        return whole.filter(alike(F.col("left"), F.col("right"))).select("a", "b")

    def possible(left: str, right: str) -> Column:
        bits = F.bit_count(F.col(f"simhash_{left}").bitwiseXOR(F.col(f"simhash_{right}")))
        return (bits <= LOOSE) & _length_allows(left, right)

    counted = lambda c: involved.select(F.col("simhash").alias(c), F.col("forms").alias(f"forms_{c}"))
    sided = lambda value, side: family.select(F.col("simhash").alias(value), F.col("id").alias(f"id_{side}"), F.col("length").alias(f"length_{side}"))
    ordered = lambda rows: rows.filter(_length_allows("l", "r")).select(F.least("id_l", "id_r").alias("a"), F.greatest("id_l", "id_r").alias("b"))

    def across(values: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
        """The pairs of forms of pairs of values, and the pairs of values that have too many."""
        values = scratch.keep(values.join(counted("a"), "a").join(counted("b"), "b").withColumn("many", F.col("forms_a") * F.col("forms_b") > CAP), label)
        pairs = values.filter("NOT many").join(sided("a", "l"), "a").join(sided("b", "r"), "b")
        return ordered(pairs), values.filter("many").select(F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("simhash"))

    same = family.filter((F.col("forms") > 1) & (F.col("forms") <= CAP)).select("simhash", F.col("id").alias("id_l"), F.col("length").alias("length_l"))
    leaders = same.groupBy("simhash").agg(F.min(F.struct("id_l", "length_l")).alias("x")).select("simhash", "x.*")
    star = leaders.join(sided("simhash", "r"), "simhash").filter("id_l <> id_r")
    first, hot = across(met.groupBy(F.col("simhash").alias("a")).agg(F.min("first").alias("b")).filter("b IS NOT NULL"), "near")
    found, skipped = scratch.keep(linked(first.unionByName(ordered(star))), "linked"), [hot]
    for turn in range(1, ROUNDS + 2):
        roots = components(scratch, found, f"roots-{turn}")
        placed = scratch.keep(family.join(bounded_bytes(roots, 64), "id", "left").withColumn("root", F.coalesce("root", "id")), f"placed-{turn}")
        each = placed.groupBy("simhash").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("id").alias("id"))
        rooted = scratch.keep(each.select("simhash", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(-1 - F.col("id")).alias("root")), f"value-roots-{turn}")
        apart = scratch.keep(apart_values(met, rooted, turn), f"apart-{turn}")
        pairs, rows = apart.agg(F.coalesce(F.sum(F.size("all")), F.lit(0)), F.count("*")).first()
        if turn > ROUNDS or pairs <= max(FEW_PAIRS, AT_ONCE * rows):
            break
        two = F.least("root", "one.root"), F.greatest("root", "one.root")
        drawn = apart.groupBy(*[c.alias(n) for c, n in zip(two, "lh", strict=True)]).agg(F.min(F.struct("a", F.col("one.simhash").alias("b"))).alias("x")).select("x.*")
        drawn, more = across(drawn, f"drawn-{turn}")
        skipped.append(more)
        new = scratch.keep(linked(drawn), f"linked-{turn}")
        stars = roots.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
        found = stars.unionByName(new)  # the links so far as stars
    rest, more = across(apart.select("a", F.explode("all").alias("x")).select("a", F.col("x.simhash").alias("b")).distinct(), "apart-pairs")
    mixed = placed.filter((F.col("forms") > 1) & (F.col("forms") <= CAP)).join(rooted.filter("root < 0").select("simhash"), "simhash", "left_semi")
    left = mixed.select("simhash", F.col("id").alias("id_l"), F.col("length").alias("length_l"), F.col("root").alias("root_l"))
    right = mixed.select("simhash", F.col("id").alias("id_r"), F.col("length").alias("length_r"), F.col("root").alias("root_r"))
    inside = left.join(right, "simhash").filter("id_l < id_r AND root_l <> root_r")
    stars = roots.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    found = stars.unionByName(scratch.keep(linked(rest.unionByName(ordered(inside))), "linked-rest"))
    keys = [*skipped, more, sized.filter(F.col("forms") > CAP).select(F.xxhash64("simhash").alias("key"), "simhash")]
    keys = scratch.keep(reduce(DataFrame.unionByName, [*keys, crowded] if crowded else keys).distinct(), "hot-keys")
    if keys.isEmpty():
        return found
    postings = scratch.keep(keys.join(family, "simhash").select("key", "id", "simhash", "length"), "hot-postings")
    roots = groups(scratch, postings, possible, lambda rows: rows.select(F.col("id_l").alias("a"), F.col("id_r").alias("b")), linked)
    return found.unionByName(roots.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))


def repeated_lines(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """The lines to remove: doc_id, version, line."""
    docs = docs.select("doc_id", "text")
    with setting(scratch.spark, "spark.sql.codegen.hugeMethodLimit", "8000"):  # what the JVM still compiles
        seen = scratch.keep(_occurrences(docs), "occurrences")
    forms = seen.groupBy("h1", "h2", "length").agg(F.min(F.struct("doc_id", "line", "version")).alias("place"), F.count("*").alias("uses"), F.first("simhash").alias("simhash"))
    forms = scratch.keep(forms.withColumn("id", F.monotonically_increasing_id()), "forms")
    roots = components(scratch, links(scratch, docs, forms.select("id", "simhash", "length", "place")), "roots")
    rooted = forms.join(bounded_bytes(roots, 64), "id", "left").filter("root IS NOT NULL OR uses > 1").withColumn("root", F.coalesce("root", "id"))
    rooted = scratch.keep(rooted.select("root", "h1", "h2", "length", "uses", "id", "place"), "rooted")
    stays = scratch.keep(rooted.groupBy("root").agg(F.min("place").alias("stay"), F.count("*").alias("forms")), "stays")
    repeated = join_counted(rooted.select("root", "h1", "h2", "length", "uses", "id"), stays, ["root"], "forms", -1 - F.col("id"))
    repeated = scratch.keep(repeated.select("h1", "h2", "length", "uses", "stay"), "repeated")
    met = join_counted(seen.select("doc_id", "version", "line", "length", "h2", "h1"), repeated, ["length", "h2", "h1"], "uses", F.xxhash64("doc_id", "version", "line"), 64)
    stay = F.col("doc_id").eqNullSafe(F.col("stay.doc_id")) & (F.col("version") == F.col("stay.version")) & (F.col("line") == F.col("stay.line"))
    return met.filter(F.col("stay").isNotNull() & ~stay).select("doc_id", "version", "line").distinct()


def dedup_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``row`` (the columns of ``docs``, ``text`` without repeated lines), n_lines and n_removed.

    Lines without a letter or digit have no normal form and always stay; null
    and empty texts stay as they are. Rows that repeat both doc_id and text
    are one document: each of them loses the same lines. Lines are told apart
    by 96 bits of hashes and their length. An empty input gives an empty result.
    """
    scratch = Scratch(spark, "line-dedup")
    gone = repeated_lines(scratch, docs).groupBy("doc_id", "version").agg(F.collect_set("line").alias("gone"))
    gone = bounded_bytes(scratch.keep(gone, "gone"), 128).select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("i"), version_of(F.col("text")).alias("w"))
    met = rows.join(gone, F.col("i").eqNullSafe(F.col("d")) & (F.col("w") == F.col("v")), "left")
    lines = lines_of(F.col("row.text"))
    stay = lambda all_: F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("gone")), lambda i: F.get(all_, i))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(_bound(lines, stay), "\n"))
    return met.select(
        F.col("row").withField("text", text).alias("row"),
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )


def without_repeated_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without repeated lines, and without the rows that lose all their words by that; n_chars follows the text."""
    found = dedup_lines(spark, docs)
    emptied = (F.col("n_removed") > 0) & (F.trim(F.translate(normal(F.col("row.text")), "\n", " ")) == "")
    row = F.col("row").withField("n_chars", F.length("row.text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else F.col("row")
    return found.filter(~F.coalesce(emptied, F.lit(False))).select(F.when(F.col("n_removed") > 0, row).otherwise(F.col("row")).alias("row")).select("row.*")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (hash of the text that stays) of every document."""
    found = dedup_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("row.text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
