"""Order MinHash fingerprints of documents, in DataFrame functions only.

A text's symbols are its runs of other than white space, cut into pieces of at most ``PIECE``
characters; a k-mer is ``k`` consecutive symbols, as a 64-bit hash. Repeats are told by its upper
bits, 64 less those that number the text's symbols (54 for a thousand symbols, 44 for a million);
a k-mer that is taken for a repeat of another so has but another hash. Every occurrence of a k-mer is
hashed together with its occurrence number (how many equal k-mers stand before it), so repeats
count apart. ``components / TURNS`` independent hash functions order the occurrences on a circle.
From ``TURNS`` evenly spaced points of each, the ``picks`` next occurrences are taken, put back into
text order, and hashed as a tuple: a component. (An order of its own for each component costs several
times as much; the points of one order lie an eighth apart, so that their picks only meet in texts
of a few k-mers. Tests compare the error with that of independent orders.) Two texts agree in a component
where they hold the same occurrences in the same order, so likeness follows edit distance rather
than shared content. A component has 32 bits, and likeness compares what the fingerprint shows.

All of it is array functions on one row: no rows are made of k-mers and nothing is shuffled. Time
follows the text's length times the hash functions, and memory the text's length: a function's hashes
are dropped before the next one's are made.

Null texts are empty ones. A text without k-mers (empty or white space) has its own fingerprint,
alike only to its equals; one of fewer than ``k`` symbols has a single k-mer, and one of fewer
k-mers than ``picks`` takes all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

K = 3
PIECE = 8
COMPONENTS = 32
PICKS = 2
TURNS = 8  # components of one hash function
RANGE_CHARS = 1 << 26  # characters of a range of with_next


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_signature(df: DataFrame, text: str, to: str, k: int = K, components: int = COMPONENTS, picks: int = PICKS) -> DataFrame:
    """Adds column ``to``: an array of ``components`` 32-bit hashes, null where the text has no k-mer.

    In steps, each a column that the next reads several times.
    """
    symbols, kmers, mask, placed, repeats, starts, hashes, places = (f"_{to}_{x}" for x in ("symbols", "kmers", "mask", "placed", "repeats", "starts", "hashes", "places"))
    low, high = F.col(mask), F.bitwise_not(F.col(mask))
    df = df.withColumn(symbols, F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0)))
    kmer = F.transform(symbols, lambda x, i: F.xxhash64(x, *[F.get(symbols, i + j) for j in range(1, k)]))
    df = df.withColumn(kmers, F.slice(kmer, F.lit(1), F.greatest(F.size(symbols) - (k - 1), F.lit(1))))
    # A hash in the upper bits of a number, its place in as many lower ones as the text needs; sorted, equal k-mers stand together in text order.
    df = df.withColumn(mask, F.pow(F.lit(2.0), F.ceil(F.log2(F.size(symbols) + 1.0))).cast("long") - 1)
    df = df.withColumn(placed, F.sort_array(F.transform(kmers, lambda x, i: x.bitwiseAND(high).bitwiseOR(i.cast("long")))))
    of, at = (lambda x: x.bitwiseAND(high)), (lambda x: x.bitwiseAND(low).cast("int"))
    df = df.withColumn(repeats, F.filter(placed, lambda x, i: of(x) == of(F.get(placed, i - 1))))
    # First occurrences keep their hash; later ones, numbered within their run, are hashed with the number.
    new_run = lambda i: (i == 0) | (of(F.get(repeats, i)) != of(F.get(repeats, i - 1)))
    df = df.withColumn(starts, F.when(F.size(repeats) > 0, F.filter(F.sequence(F.lit(0), F.size(repeats) - 1), new_run)))
    runs = F.transform(starts, lambda a, r: F.slice(repeats, a + 1, F.coalesce(F.get(starts, r + 1), F.size(repeats)) - a))
    numbered = F.flatten(F.transform(runs, lambda run: F.transform(run, lambda x, c: F.xxhash64(F.get(kmers, at(x)), c + 1))))
    df = df.withColumn(placed, F.when(F.size(repeats) > 0, F.array_except(placed, repeats)).otherwise(F.col(placed)))
    once = F.transform(placed, lambda x: F.get(kmers, at(x)))
    df = df.withColumn(hashes, F.when(F.size(repeats) > 0, F.concat(once, numbered)).otherwise(once))
    df = df.withColumn(places, F.transform(F.concat(placed, repeats), at))
    marks = [-(1 << 63) + j * ((1 << 64) // TURNS) for j in range(TURNS)]

    def components_of(c: Column) -> Column:
        """The ``TURNS`` components of hash function ``c``."""

        def at_marks(t: Column) -> Column:
            return _let(F.sort_array(F.concat(t, F.array(*[F.lit(m) for m in marks]))), lambda s: turns(t, s))

        def turns(t: Column, s: Column) -> Column:
            # How many hashes are less than each mark, and the hash that is e-th from the least.
            less = F.array(*[F.array_position(s, m).cast("int") - (1 + j) for j, m in enumerate(marks)])
            return _let(less, lambda n: F.transform(n, lambda first: tuple_of(t, s, n, first)))

        def tuple_of(t: Column, s: Column, n: Column, first: Column) -> Column:
            ranks = F.transform(F.array(*[(first + i) % F.size(t) for i in range(picks)]), lambda e: F.get(s, e + sum(F.when(F.get(n, F.lit(j)) <= e, 1).otherwise(0) for j in range(TURNS))))
            where = lambda m: F.array_position(t, m).cast("int") - 1
            in_text = F.sort_array(F.transform(ranks, lambda m: _let(where(m), lambda i: F.struct(F.get(places, i).alias("at"), F.get(hashes, i).alias("h")))))
            return F.xxhash64(F.transform(in_text, lambda x: x["h"])).bitwiseAND(F.lit(0xFFFFFFFF))

        return _let(F.transform(hashes, lambda x: F.xxhash64(x, c)), at_marks)

    df = df.withColumn(to, F.when(F.size(symbols) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.lit(components // TURNS - 1)), components_of))))
    return df.drop(symbols, kmers, mask, placed, repeats, starts, hashes, places)


def fingerprint(sig: Column) -> Column:
    """The signature as text: the 32 bits of each component in hexadecimal; ``-`` where there is none."""
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit("-"))


def likeness(a: Column, b: Column, components: int = COMPONENTS) -> Column:
    """The share of components in which two signatures agree."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(components - 1)), lambda i: F.get(a, i) == F.get(b, i))) / F.lit(float(components))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` (doc_id and ``columns``) with _next, a struct of the columns of the document of the next greater doc_id.

    The last is followed by the first. Ids are dealt over ranges that start at ids which occur, of
    about RANGE_CHARS characters of text at most; the row at the start of a range also goes to the
    range before, so each row finds its next one in its own range: one shuffle, and no task holds
    more than a range (the rows of one id are in one range). Rows of equal id are
    ordered by the columns; a null id comes first.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-size // RANGE_CHARS))
    low, cuts = docs.agg(F.min(key), F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], max(10_000, 10 * parts))).first()
    if low is None:
        return docs.withColumn("_next", F.struct(*columns))
    cuts = sorted({low, *cuts})
    # Cuts in groups of about the root of their number: the group is found first, then the cut within it.
    width = max(1, int(len(cuts) ** 0.5))
    groups = F.array(*[F.array(*[F.lit(c) for c in cuts[i : i + width]]) for i in range(0, len(cuts), width)])
    last_of = lambda xs, first: F.size(F.filter(xs, lambda c: first(c) <= key)) - 1
    at = _let(last_of(groups, lambda g: F.get(g, F.lit(0))), lambda g: g * width + last_of(F.get(groups, g), lambda c: c))
    before = F.when(F.col("_at") == 0, len(cuts) - 1).otherwise(F.col("_at") - 1)
    starts_here = F.get(F.get(groups, F.floor(F.col("_at") / width).cast("int")), F.col("_at") % width) == key
    at, docs = F.col("_at"), docs.withColumn("_at", at)
    seats = F.when(starts_here, F.array(F.struct(at.alias("part"), F.lit(0).alias("guard")), F.struct(before.alias("part"), F.lit(1).alias("guard")))).otherwise(F.array(F.struct(at.alias("part"), F.lit(0).alias("guard"))))
    rows = docs.withColumns({"_key": key, "_seat": F.explode(seats)})
    order = Window.partitionBy("_seat.part").orderBy("_seat.guard", "_key", *[c for c in columns])
    return rows.withColumn("_next", F.lead(F.struct(*columns)).over(order)).where("_seat.guard = 0").drop("_key", "_seat", "_at")


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row of ``docs`` (doc_id, text) and of its text with the latter half exchanged.

    The last floor(n_chars / 2) characters give way to the first as many (or all) of the next
    document. near_edited and near_next are likenesses to the edited text and the next document.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(with_signature(rows, "text", "sig"), ["text", "sig"])
    half = F.expr("length(text) div 2").cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.col("_next.text"), F.lit(1), half)))
    rows = with_signature(rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", "sig", F.col("_next.sig").alias("next_sig")), "edited", "edited_sig")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sig")).alias("fingerprint"), fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
