"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Equal lines are one class (by two 64-bit hashes). Two different lines within `threshold` edits
share one of threshold + 1 segments of the shorter line, at nearly its place: every line lists its
own segments with its length, and probes, for each length that can match, the few substrings at
places that a segment could have moved to. Pairs found are verified by a banded bit-parallel edit
distance: a word of 2 * threshold + 1 bits holds a column of the band, and a fold over the text's
characters moves it down the diagonal. Only what is left between the pair's common start and end is
folded over.

A changed word is more edits than the threshold. With `words`, the same join also runs over the words
of lines of `MIN_CHARS` characters and `WORDS_LEAST` words: those that are equal but for one word
changed, put in or taken out are linked as well, whatever their length.

A segment that many lines list (more than `RARE`) doesn't give all pairs. At one edit its lines
differ in what is beside the segment only, and by one edit again: that rest is cut into segments in
turn, and lines go on together only if they share one of these too, until lists are short or the
rest is one character (or word), where any two lines of a list are linked and a hub stands for all.
At more edits the lines of such a list are paired with one hub, and what isn't in the hub's component
then is compared with the list in blocks, letting through only pairs whose character parities are
close enough.

Texts of lines are neither shuffled nor stored: keys are made where a document is read, and the lines
of the pairs found are read again.

The first line of a component (least doc_id, then line number) is kept, the others are repeats.

Defined results: lines end at "\\n"; lines shorter than `min_chars` code points (none in the
query and in `without_repeats`) are left out; a null text has no lines; texts are taken whole; doc_id and line number name a line, so
rows that repeat both count as one; rows with a null id are handled like any other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeloom.llm.common import Shelf, cut, keyed
from spikeloom.llm.components import components

THRESHOLD = 1
MIN_CHARS = 20
RARE = 16
BLOCK = 256
#: What has none of these has no word.
WORD = r"[\p{L}\p{N}]"
#: So many common segments at most are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 10_000
#: So many ids of lines to verify at most are broadcast.
BROADCAST_IDS = 500_000
#: Lines of MIN_CHARS and so many words can be linked by all words but one.
WORDS_LEAST = 4


def split_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, line_no, line, n and two hashes of every line long enough."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("n", F.length("line")).filter(F.col("n") >= min_chars)
    return lines.select("doc_id", "line_no", "line", "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


# -- segments and probes


def _segment(n: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of a line of n characters; the last ones are longer."""
    size, longer = F.floor(n / parts).cast("int"), n % parts
    first_longer = F.lit(parts) - longer
    start = size * i + F.greatest(F.lit(0), F.lit(i) - first_longer)
    return start, size + F.when(F.lit(i) >= first_longer, 1).otherwise(0)


def _piece(line: Column, start: Column, size: Column) -> Column:
    return F.substring(line, start + 1, size)


def split_words(line: Column) -> Column:
    """The line's words; most lines have single spaces only, which costs least to tell and to split."""
    odd = F.lit(False)
    for c in ("  ", "\t", "\x0b", "\f", "\r"):
        odd = odd | F.contains(line, F.lit(c))
    odd = odd | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.split(F.when(odd, F.trim(F.regexp_replace(line, r"[ \t\x0B\f\r]+", " "))).otherwise(line), " ")


def _word_piece(words: Column, start: Column, size: Column) -> Column:
    return F.slice(words, F.greatest(start, F.lit(0)) + 1, size)


def _key(of: Column, i: int, piece: Column) -> Column:
    """The key of a segment: of its line's length (below zero if it counts words) or of the segment it lies beside."""
    return F.xxhash64(of.cast("long"), F.lit(i), piece)


def listed_segments(line: Column, n: Column, threshold: int, piece=_piece, sign: int = 1) -> Column:
    keys = []
    for i in range(threshold + 1):
        start, size = _segment(n, i, threshold + 1)
        keys.append(_key(sign * n, i, piece(line, start, size)))
    return F.array(*keys)


def probed_substrings(line: Column, n: Column, threshold: int, piece=_piece, sign: int = 1) -> Column:
    """Keys of the substrings where a segment of an equal or shorter line could be, null for places outside.

    With i segments before and threshold - i after it, one that is untouched while the edits on
    either side stay fewer than the segments there is shifted by at most i from its place counted
    from the start, and by at most threshold - i from its place counted from the end.
    """
    keys = []
    for less in range(threshold + 1):
        shorter = n - less
        for i in range(threshold + 1):
            start, size = _segment(shorter, i, threshold + 1)
            low, high = max(-i, less - (threshold - i)), min(i, less + (threshold - i))
            for shift in range(low, high + 1):
                if less or shift:  # the line's own segments are listed
                    at = start + shift
                    key = _key(sign * shorter, i, piece(line, at, size))
                    keys.append(F.when((at >= 0) & (at + size <= n), key))
    return F.array(*keys)


def with_keys(lines: DataFrame, threshold: int, words: bool) -> DataFrame:
    """The lines with the keys that they list, and those that they probe besides; keys may be null."""
    text, n, none = F.col("line"), F.col("n"), F.array().cast("array<bigint>")
    sides = {"listed": listed_segments, "probed": probed_substrings}
    by_char = {k: F.when(n > 2 * threshold, make(text, n, threshold)).otherwise(none) for k, make in sides.items()}
    if not words:
        return lines.select("*", *[v.alias(k) for k, v in by_char.items()])
    # bound by _let, so that the expressions over words don't make the generated code too long to compile
    keys = lambda ws: F.when(F.size(ws) >= WORDS_LEAST, F.struct(*[make(ws, F.size(ws), 1, _word_piece, -1).alias(k) for k, make in sides.items()]))
    lines = lines.withColumn("by_word", F.when(n >= MIN_CHARS, _let(split_words(text), keys)))
    return lines.select("*", *[F.concat(by_char[k], F.coalesce(F.col("by_word")[k], none)).alias(k) for k in sides]).drop("by_word")


# -- verification


def _let(value: Column, body) -> Column:
    """The body with the value bound to a name, so that it is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shared_start(a: Column, b: Column) -> Column:
    """How many characters both start with: a fold over halving steps, each comparing two slices."""
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])

    def grow(known: Column, step: Column) -> Column:
        fits = (known + step <= F.length(a)) & (known + step <= F.length(b))
        return F.when(fits & (F.substring(a, known + 1, step) == F.substring(b, known + 1, step)), known + step).otherwise(known)

    return F.aggregate(steps, F.lit(0), grow)


def _after(pair: Column, start: Column, turn) -> Column:
    """Both texts from a place on, turned by a function."""
    return F.struct(*[turn(F.substring(pair[k], start + 1, F.length(pair[k]))).alias(k) for k in "xy"])


def _band(p: Column, t: Column, threshold: int) -> Column:
    """The edit distance of two arrays of characters, the first not the shorter, if within the threshold.

    Bit k of a column's word stands for the row k - threshold below the diagonal. The cost follows
    the band's lowest diagonal down to the last row, and then that row to its end.
    """
    width = 2 * threshold + 1
    mask = F.lit((1 << width) - 1)
    bit = lambda word, k: F.call_function("shiftright", word, k).bitwiseAND(F.lit(1))

    def column(state: Column, j: Column) -> Column:
        vp, vn, c = state["vp"], state["vn"], F.element_at(t, j)
        match = F.lit(0)
        for k in range(width):
            match = match + F.when(F.get(p, j - 1 + k - threshold) == c, 1 << k).otherwise(0)

        def moved(d: Column) -> Column:
            hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp))).bitwiseAND(mask)
            hn = d.bitwiseAND(vp)
            below = F.shiftright(d, 1)
            edge = F.greatest(F.lit(threshold) + F.size(p) - j, F.lit(0))
            cost = F.when(j <= F.size(p) - threshold, 1 - bit(d, F.lit(width - 1))).otherwise(bit(hp, edge) - bit(hn, edge))
            down = hn.bitwiseOR(F.bitwise_not(below.bitwiseOR(hp))).bitwiseAND(mask)
            return F.struct(down.alias("vp"), below.bitwiseAND(hp).alias("vn"), (state["cost"] + cost).alias("cost"))

        diagonal = lambda x: ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(mask)
        return _let(_let(match, diagonal), moved)

    start = F.struct(F.lit((1 << width) - (1 << threshold)).alias("vp"), F.lit(0).alias("vn"), F.lit(threshold).alias("cost"))
    return F.aggregate(F.sequence(F.lit(1), F.size(t)), start, column)["cost"]


def edit_distance_within(a: Column, b: Column, threshold: int) -> Column:
    """Whether at most `threshold` edits turn a into b.

    The common start and end are taken off; sentinels, equal on both sides, keep the rest longer
    than the band.
    """
    pad = F.array(*[F.lit("")] * (threshold + 1))
    chars = lambda x: F.concat(F.filter(F.split(x, ""), lambda c: c != ""), pad)

    def folded(core: Column) -> Column:
        swap = F.length(core["x"]) < F.length(core["y"])
        sides = F.struct(chars(F.when(swap, core["y"]).otherwise(core["x"])).alias("p"), chars(F.when(swap, core["x"]).otherwise(core["y"])).alias("t"))
        return _let(sides, lambda s: _band(s["p"], s["t"], threshold) <= threshold)

    def trimmed(pair: Column) -> Column:
        same = lambda p: _shared_start(p["x"], p["y"])
        rest = _let(same(pair), lambda head: _after(pair, head, F.reverse))
        return _let(rest, lambda r: _let(_let(same(r), lambda tail: _after(r, tail, lambda x: x)), folded))

    close = F.abs(F.length(a) - F.length(b)) <= threshold
    return F.when(close, _let(F.struct(a.alias("x"), b.alias("y")), trimmed)).otherwise(F.lit(False))


def one_word_apart(a: Column, b: Column) -> Column:
    """Whether two arrays of words are equal but for one word changed, put in or taken out."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")  # the first difference
    more = F.size(a) - F.size(b)
    rest = lambda x, skip: F.slice(x, at + skip, F.size(x) + 1)
    same = F.when(more == 0, rest(a, 1) == rest(b, 1)).when(more == 1, rest(a, 1) == rest(b, 0)).when(more == -1, rest(a, 0) == rest(b, 1))
    return F.when(at == 0, True).otherwise(F.coalesce(same, F.lit(False)))


def verified(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], threshold: int, words: bool = False) -> DataFrame:
    """The pairs (a, b) whose lines are within the threshold or, if words count, a word apart."""
    pairs = cut(pairs)
    lines = texts(pairs.select(F.explode(F.array("a", "b")).alias("id")))
    sides = [lines.select(F.col("id").alias(k), F.col("line").alias(f"l{k}")) for k in "ab"]
    met = pairs.join(sides[0], "a").join(sides[1], "b")
    if words:
        met = met.select("*", split_words(F.col("la")).alias("wa"), split_words(F.col("lb")).alias("wb"))
        enough = [(F.length(f"l{k}") >= MIN_CHARS) & (F.size(f"w{k}") >= WORDS_LEAST) for k in "ab"]
        apart = _let(F.struct("wa", "wb"), lambda w: one_word_apart(w["wa"], w["wb"]))
        met = met.select("a", "b", "la", "lb", (enough[0] & enough[1] & apart).alias("near"))
        return met.filter(F.col("near") | edit_distance_within(F.col("la"), F.col("lb"), threshold)).select("a", "b")
    near = edit_distance_within(F.col("la"), F.col("lb"), threshold)
    return met.filter(near).select("a", "b")


def _parities(parts: Column) -> Column:
    """A 64-bit word with the parity of the parts' counts, by hash: an edit changes two bits at most."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c), F.lit(64)).cast("int"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda word, c: word.bitwiseXOR(bit(c)))


# -- the join


def _narrowed(rows: DataFrame) -> DataFrame:
    """For rows of a list (key, id, probe, w, rest), where rest is what the segments so far leave of a
    line: the keys of the rest's own segments, with what these leave. A probe looks for a rest that is
    one shorter. A rest of one character or word is a leaf: lines that list it are linked with all that
    share their key, and with the probes that hold its one."""
    w, rest, key = F.col("w"), F.col("rest"), F.col("key")
    rows = rows.select("*", F.when(w, F.split(rest, " ")).alias("units"))
    n = F.when(w, F.size("units")).otherwise(F.length(rest))
    rows = rows.select("*", n.alias("n"), (n - F.col("probe").cast("int")).alias("t"))
    n, t, units = F.col("n"), F.col("t"), F.col("units")
    half = F.floor(t / 2).cast("int")

    def part(i: int, start: Column, size: Column, left_from: Column, left: Column, leaf: bool = False) -> Column:
        name = F.when(w, _key(key, i, _word_piece(units, start, size))).otherwise(_key(key, i, _piece(rest, start, size)))
        other = F.when(w, F.array_join(_word_piece(units, left_from, left), " ")).otherwise(_piece(rest, left_from, left))
        return F.struct(name.alias("key"), other.alias("rest"), F.lit(leaf).alias("leaf"))

    zero, one = F.lit(0), F.lit(1)
    halves = F.array(part(0, zero, half, half, n - half), part(1, n - (t - half), t - half, zero, n - (t - half)))
    first, second, any_one = (part(i, F.lit(at), size, zero, one, True) for i, at, size in ((2, 0, one), (2, 1, one), (3, 0, zero)))
    leaves = F.when(F.col("probe"), F.array(first, second)).otherwise(F.array(first, any_one))
    return rows.select("id", "probe", "w", F.explode(F.when(t > 1, halves).otherwise(leaves)).alias("p")).select("p.key", "id", "probe", "w", "p.rest", "p.leaf")


def _met(listed: DataFrame, asking: DataFrame) -> DataFrame:
    """Pairs of the ids that list a key with all that list or probe it."""
    pairs = listed.select("key", F.col("id").alias("x")).join(asking.select("key", F.col("id").alias("y")), "key").filter("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _narrowing(lines: DataFrame, common: DataFrame, shelf: Shelf, words: bool) -> DataFrame:
    """Pairs of lines (id, line) from the lists of common keys, at one edit."""
    ws = split_words(F.col("line"))
    n = F.length("line")
    sides = [(False, n, F.col("line"), n > 2)]
    if words:
        sides.append((True, F.size(ws), F.array_join(ws, " "), (n >= MIN_CHARS) & (F.size(ws) >= WORDS_LEAST)))
    sign = lambda w: -1 if w else 1
    whole = [
        lines.filter(fits).select((F.lit(sign(w)) * (size - int(probe))).cast("long").alias("key"), "id", F.lit(probe).alias("probe"), F.lit(w).alias("w"), rest.alias("rest"))
        for w, size, rest, fits in sides
        for probe in (False, True)
    ]
    rows = whole[0]
    for more in whole[1:]:
        rows = rows.unionByName(more)
    rows, level, found = _narrowed(rows).join(common, "key", "left_semi"), 0, None
    while True:
        rows = shelf.put(_narrowed(rows.select("key", "id", "probe", "w", "rest")), f"level{level}")
        if level:
            shelf.drop(f"level{level - 1}")
        lists = cut(rows.filter("NOT probe").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("hub"), F.first("leaf").alias("leaf")))
        stars = rows.filter("leaf").join(lists.select("key", "hub"), "key").filter("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
        short = rows.filter("NOT leaf").join(lists.filter(F.col("leaf") | (F.col("n") > RARE)).select("key"), "key", "left_anti")
        new = cut(stars.unionByName(_met(short.filter("NOT probe"), short)).distinct())
        found = new if found is None else found.unionByName(new)
        long = lists.filter(~F.col("leaf") & (F.col("n") > RARE)).select("key")
        if long.isEmpty():
            shelf.drop(f"level{level}")
            return found
        rows, level = rows.join(long, "key", "left_semi"), level + 1


def _by_blocks(pairs: DataFrame, members: DataFrame, texts, shelf: Shelf, threshold: int, words: bool) -> DataFrame:
    """node and root by the pairs and by the lists (key, id) of common keys, at more edits than one."""
    apart = max(threshold, int(words))
    lines = texts(members.select("id")).select("id", F.length("line").alias("n"), _parities(F.split("line", "")).alias("parity"), _parities(split_words(F.col("line"))).alias("by_word"))
    members = shelf.put(members.join(lines, "id"), "members")
    hubs = cut(members.groupBy("key").agg(F.min("id").alias("hub")))
    starred = members.join(hubs, "key").filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    links = cut(verified(pairs.unionByName(starred).distinct(), texts, threshold, words))
    roots = cut(components(links))

    rooted = lambda df, k, r: df.join(roots.select(F.col("node").alias(k), F.col("root").alias(r)), k, "left").withColumn(r, F.coalesce(r, k))
    one = F.struct("id", "n", "root", "parity", "by_word")
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = rooted(members, "id", "root").join(sizes, "key")
    blocks = placed.withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).groupBy("key", "block").agg(F.collect_list(one).alias("ms"))
    strays = placed.join(rooted(hubs, "hub", "centre"), "key").filter("root <> centre")
    strays = strays.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), one.alias("s"))
    close = lambda m, by: F.bit_count(m[by].bitwiseXOR(F.col(f"s.{by}"))) <= 2 * apart
    by_chars = lambda m: (F.abs(m["n"] - F.col("s.n")) <= threshold) & close(m, "parity")
    near = lambda m: (m["root"] != F.col("s.root")) & (by_chars(m) | close(m, "by_word") if words else by_chars(m))
    more = strays.join(blocks, ["key", "block"]).select("s", F.explode(F.filter("ms", near)).alias("m"))
    more = more.select(F.least("s.id", "m.id").alias("a"), F.greatest("s.id", "m.id").alias("b")).distinct()
    found = cut(components(links.unionByName(verified(more, texts, threshold, words))))
    shelf.drop("members")
    return found


def line_links(distinct: DataFrame, texts: Callable[[DataFrame], DataFrame], shelf: Shelf, threshold: int, words: bool = False) -> DataFrame:
    """node and root of lines (id, listed, probed) that are within the threshold of another, or a word apart.

    `texts` gives id and line for a table of ids."""
    listed = distinct.select("id", F.explode("listed").alias("key")).filter("key IS NOT NULL")
    asking = distinct.select("id", F.explode(F.concat("listed", "probed")).alias("key")).filter("key IS NOT NULL")
    common = cut(listed.groupBy("key").count().filter(F.col("count") > RARE).select("key"))
    if (most := common.count()) <= BROADCAST_ROWS:
        common = F.broadcast(common)
    pairs = _met(listed.join(common, "key", "left_anti") if most else listed, asking).distinct()
    if most:
        members = cut(asking.join(common, "key", "left_semi"))
        if threshold > 1:
            return _by_blocks(pairs, members, texts, shelf, threshold, words)
        pairs = pairs.unionByName(_narrowing(texts(members.select("id")), common, shelf, words)).distinct()
    return components(verified(pairs, texts, threshold, words))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, words: bool = False) -> DataFrame:
    """doc_id, line_no, first_doc_id, first_line_no, kept and exempt of every line of at least `min_chars`.

    Equal lines are a class whatever their length; the edit join takes lines of 2 * threshold + 1
    characters. Exempt lines aren't to be removed: those without a letter or digit, and those under
    `MIN_CHARS` that are the first of their equals (a short line's edit makes it another).
    """
    shelf = Shelf(docs.sparkSession)
    lines = split_lines(keyed(docs, doc_id=doc_id, text=text), min_chars)
    first = F.min(F.struct("doc_id", "line_no", "listed", "probed"))
    distinct = with_keys(lines, threshold, words).groupBy("h1", "h2").agg(first.alias("f"))
    distinct = shelf.put(distinct.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "f.*"), "lines")

    def texts(ids: DataFrame) -> DataFrame:
        ids = cut(ids.distinct())
        few = ids.count() <= BROADCAST_IDS
        names = cut(distinct.select("id", "h1", "h2").join(F.broadcast(ids) if few else ids, "id", "left_semi"))
        found = lines.select("h1", "h2", "line").join(F.broadcast(names) if few else names, ["h1", "h2"])
        return found.groupBy("id").agg(F.first("line").alias("line"))

    roots = line_links(distinct.select("id", "listed", "probed"), texts, shelf, threshold, words)
    classes = distinct.select("id", "h1", "h2", F.struct("doc_id", "line_no").alias("own"))
    linked = classes.join(roots, classes["id"] == roots["node"]).select("h1", "h2", "own", "root")
    firsts = linked.groupBy("root").agg(F.min("own").alias("own"))
    changed = cut(linked.select("h1", "h2", "root").join(firsts, "root").select("h1", "h2", "own"))
    classes = classes.select("h1", "h2", F.col("own").alias("equal")).join(changed, ["h1", "h2"], "left").select("h1", "h2", "equal", F.coalesce("own", "equal").alias("f"))
    found = lines.select("doc_id", "line_no", "h1", "h2", (F.col("n") < MIN_CHARS).alias("short"), (~F.col("line").rlike(WORD)).alias("bare")).join(classes, ["h1", "h2"])
    is_first = lambda of: F.col(f"{of}.doc_id").eqNullSafe(F.col("doc_id")) & (F.col(f"{of}.line_no") == F.col("line_no"))
    exempt = F.col("bare") | (F.col("short") & is_first("equal"))
    return found.select("doc_id", "line_no", F.col("f.doc_id").alias("first_doc_id"), F.col("f.line_no").alias("first_line_no"), is_first("f").alias("kept"), exempt.alias("exempt"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, min_chars: int = 0, words: bool = True) -> DataFrame:
    """The documents without repeated lines that aren't exempt; those of which no word is left go.

    All columns stay, and the text is the remaining lines in order. Rows with a null id stay whole.
    """
    repeats = dedup_lines(docs, doc_id, text, threshold, min_chars, words).filter("NOT kept AND NOT exempt AND doc_id IS NOT NULL")
    gone, key = "_spikeloom_gone", "_spikeloom_id"
    repeats = repeats.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line_no").alias(gone))
    joined = docs.join(repeats, F.col(f"`{doc_id}`") == F.col(key), "left").drop(key)
    left = F.filter(F.split(F.col(f"`{text}`"), "\n", -1), lambda line, i: ~F.array_contains(F.col(gone), i))
    joined = joined.withColumn(text, F.when(F.col(gone).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(left, "\n")))
    some = F.col(gone).isNull() | F.col(f"`{text}`").rlike(WORD)
    return joined.filter(some).drop(gone)
