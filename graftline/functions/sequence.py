"""Sequence functions as Column expressions, and named SQL functions."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_upper(s: Column | str) -> Column:
    """Upper case of a-z alone, which every engine agrees on."""
    return F.translate(col(s), _LOWER, _UPPER)


def revcomp(s: Column | str) -> Column:
    """Reverse complement; characters other than A, C, G and T stay."""
    return F.translate(F.reverse(ascii_upper(s)), "ACGT", "TGCA")


def canonical(s: Column | str) -> Column:
    """The lesser of a sequence and its reverse complement: one key for both strands."""
    return F.least(ascii_upper(s), revcomp(s))


def strip_flank(s: Column | str, orient: str) -> Column:
    """A flank without its uncertain far end: trailing N of a 5p flank, leading N of a 3p flank."""
    return F.regexp_replace(ascii_upper(s), "N+$" if orient == "5p" else "^N+", "")


def truncate(s: Column | str, length: int, orient: str) -> Column:
    """The insertion's end of a flank: the first characters of a 5p, the last of a 3p flank."""
    s = col(s)
    return F.substring(s, 1, length) if orient == "5p" else F.when(F.length(s) > length, F.substring(s, -length, length)).otherwise(s)


def slice_seq(s: Column | str, start: Column | int, end: Column | int) -> Column:
    """s[start:end], 0-based and half-open, with start clamped at 0."""
    start = F.greatest(F.lit(0), start if isinstance(start, Column) else F.lit(start))
    end = end if isinstance(end, Column) else F.lit(end)
    return F.substring(col(s), start + 1, F.greatest(F.lit(0), end - start))


def phred(q: Column | str) -> Column:
    """Qualities of an ASCII-33 string."""
    q = col(q)
    return F.when(F.length(q) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(q, ""), lambda c: F.ascii(c) - 33))


def phred_string(q: Column | str) -> Column:
    return F.array_join(F.transform(col(q), lambda x: F.char(x + 33)), "")


def prefix_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - levenshtein / m over the first m characters of both, m the shorter length; null if that is 0."""
    a, b = col(a), col(b)
    m = F.least(F.length(a), F.length(b))
    return 1 - F.try_divide(F.levenshtein(F.substring(a, F.lit(1), m), F.substring(b, F.lit(1), m)).cast("double"), m)


def percent_identity(aligned: Column | str, edits: Column | str) -> Column:
    return F.try_divide((col(aligned) - col(edits)).cast("double"), col(aligned))


def location(contig: Column | str, start: Column | str, end: Column | str) -> Column:
    return F.concat(col(contig), F.lit(":"), col(start).cast("string"), F.lit("-"), col(end).cast("string"))


def window_centre(a: Column | str, b: Column | str) -> Column:
    """The middle of two positions, halves to even."""
    return F.bround((col(a) + col(b)) / 2).cast("long")


def poisson_upper_tail(k: Column | str, mean: Column | str) -> Column:
    """P(X >= k) of a Poisson variable, summed term by term in logarithms."""
    k, mean = col(k), col(mean).cast("double")
    zero = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))
    below = F.aggregate(
        F.sequence(F.lit(0), F.greatest(k.cast("int") - 1, F.lit(0))),
        zero,
        lambda a, i: F.struct((a["log"] + F.when(i > 0, F.log(mean) - F.log(i)).otherwise(F.lit(0.0))).alias("log"), (a["sum"] + F.exp(a["log"] + F.when(i > 0, F.log(mean) - F.log(i)).otherwise(F.lit(0.0)) - mean)).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(k <= 0, F.lit(1.0)).when(mean <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - below))


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


def best_overlap(a: str, b: str) -> tuple[int, int, int, int, int, int]:
    """(score, mismatches, a start, a end, b start, b end) of the best ungapped overlap of a's end with b's start.

    b slides from a's last character leftwards over a; every column counts +1 or
    -1, and the first place with the best score stands.  Empty input scores 0 columns.
    """
    x, y = _codes(a), _codes(b)
    best = (-(2**31), 0, 0, 0, 0, 0)
    for shift in range(len(x) - 1, -len(y), -1):
        i, j = max(shift, 0), max(-shift, 0)
        n = min(len(x) - i, len(y) - j)
        miss = int(np.count_nonzero(x[i : i + n] != y[j : j + n]))
        if n - 2 * miss > best[0]:
            best = (n - 2 * miss, miss, i, i + n, j, j + n)
    return best


def best_overlaps(a: list[str], b: list[str]) -> np.ndarray:
    """``best_overlap`` of many pairs at once, a column each; pairs without characters to compare are all 0.

    Texts stand in columns, a's ends and b's starts in line, so each place of b is a
    comparison of two blocks of rows.
    """
    nx, ny = np.array([len(x) for x in a], np.int64), np.array([len(y) for y in b], np.int64)
    n, m = int(nx.max(initial=0)), int(ny.max(initial=0))
    x, y = np.full((n, len(a)), 0xFFFFFFFF, np.uint32), np.full((m, len(b)), 0xFFFFFFFE, np.uint32)
    for k, (p, q) in enumerate(zip(a, b, strict=True)):
        x[n - len(p) :, k], y[: len(q), k] = _codes(p), _codes(q)
    best, at = np.full(len(a), -(2**31), np.int64), np.zeros(len(a), np.int64)
    # b's first k characters stand beside a's last k.
    for k in range(1, n + m):
        low, high = max(0, k - n), min(k, m)
        same = np.add.reduce(x[n - k + low : n - k + high] == y[low:high], axis=0, dtype=np.int32)
        columns = np.minimum(nx, k) - np.maximum(k - ny, 0)
        score = 2 * same - columns
        better = (score > best) & (columns > 0)
        best[better], at[better] = score[better], k
    i, j = np.maximum(nx - at, 0), np.maximum(at - nx, 0)
    columns = np.minimum(nx - i, ny - j)
    return np.where(at > 0, np.stack([best, (columns - best) // 2, i, i + columns, j, j + columns]), 0)


def _merged(a: str, b: str, found: Iterable[int], min_score: int, min_identity: float) -> tuple[str | None, str | None]:
    """(merged sequence, location), or (None, None) if the overlap isn't good enough.

    Columns of the overlap come from a up to half of the merged length, then from b.
    """
    score, miss, i, k, j, m = found
    if k == i or score < min_score or not 1 - miss / (k - i) > min_identity:
        return None, None
    total = i + (k - i) + (len(b) - m)
    own = min(k - i, max(0, total // 2 + 1 - i))
    return a[: i + own] + b[j + own :], f"seq_5p:{i}-{k};seq_3p:{j}-{m}"


def merge_overlap(a: str, b: str, min_score: int, min_identity: float) -> tuple[str | None, str | None]:
    """(merged sequence, location) of one pair."""
    return _merged(a, b, best_overlap(a, b), min_score, min_identity)


def merge_overlaps(a: list[str | None], b: list[str | None], min_score: int, min_identity: float, step: int = 1 << 17) -> list[tuple[str | None, str | None]]:
    """``merge_overlap`` of many pairs, those of like lengths at once, ``step`` characters of the longest; null with null gives nulls."""
    out: list[tuple[str | None, str | None]] = [(None, None)] * len(a)
    known = sorted((k for k in range(len(a)) if a[k] is not None and b[k] is not None), key=lambda k: max(len(a[k]), len(b[k])))
    while known:
        part = known[-max(1, step // max(len(a[known[-1]]), len(b[known[-1]]), 1)) :]
        del known[-len(part) :]
        for k, found in zip(part, best_overlaps([a[k] for k in part], [b[k] for k in part]).T.tolist(), strict=True):
            out[k] = _merged(a[k], b[k], found, min_score, min_identity)
    return out


def char_masks(s: str) -> dict[str, int]:
    """For each character of a text the bits of its places."""
    codes = _codes(s)
    return {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes).tolist()}


#: Characters after which the masks are cut to the band anew.
_CHUNK = 512


def edit_distance_within(a: str, b: str, most: int, masks: dict[str, int] | None = None) -> int:
    """The edit distance, or most + 1 if it is greater: bit-parallel over the diagonals that so few edits can reach.

    ``masks`` may hold the ``char_masks`` of the longer text (of b, if they are equally long).
    Where no way through the band stays within ``most`` edits, the work ends.
    """
    if len(a) > len(b):
        a, b = b, a
    n, t = len(a), len(b) - len(a)
    if t > most:
        return most + 1
    if a == b or not n:
        return t
    # Of the edits beyond the difference in length, a deletion takes one for itself and one for the insertion that makes up for it.
    half = (most - t) // 2
    width = t + 2 * half + 1
    full, last = (1 << width) - 1, 1 << (width - 1)
    masks = char_masks(b) if masks is None else masks
    up, down, score = full >> half << half, 0, t + half
    # Bit k stands for b's place k - half beside a's; the potential is what the rest costs at least.
    rest, size = np.abs(t + half - np.arange(width)), -(-width // 8)
    bits = lambda x: np.unpackbits(np.frombuffer(x.to_bytes(size, "little"), np.uint8), bitorder="little")[: width - 1].astype(np.int64)
    check = most // 2 + 16
    for start in range(0, n, _CHUNK):
        cut, held = (1 << (width + _CHUNK)) - 1, {}
        for j, c in enumerate(a[start : start + _CHUNK]):
            mask = held.get(c)
            if mask is None:
                mask = masks.get(c, 0)
                mask = held[c] = (mask >> (start - half) if start >= half else mask << (half - start)) & cut
            eq = (mask >> j) & full
            diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
            plus = down | (full ^ (diagonal | up))
            minus = diagonal & up
            if not diagonal & last:
                score += 1
            diagonal >>= 1
            up = minus | (full ^ (diagonal | plus))
            down = diagonal & plus
            if start + j >= check:
                steps = np.zeros(width, np.int64)
                steps[1:] = bits(up) - bits(down)
                column = np.cumsum(steps)
                least = int((column + (score - column[-1]) + rest).min())
                if least > most:
                    return most + 1
                check = start + j + max(most - least, 24)
    beyond = ((1 << half) - 1) << (t + half)
    score -= (up & beyond).bit_count() - (down & beyond).bit_count()
    return min(score, most + 1)


#: Texts that are screened together, and steps between looks at what they have left.
_LANES, _STEPS = 256, 48


def screen_within(texts: list[str], b: str, most: list[int]) -> list[bool]:
    """False only for texts, none longer than ``b``, whose edit distance to it is greater than their ``most``.

    The bands of ``edit_distance_within`` of many texts lie side by side in one number, so
    a step is taken over all of them at once.  What is left when the shortest text ends,
    or when few are, passes.
    """
    passed = [True] * len(texts)
    if len(texts) <= 4:
        return passed
    codes = _codes(b).astype(np.uint16)  # characters that fall together can only make a text pass
    known = np.unique(codes)
    number = np.full(1 << 16, len(known), np.uint16)
    number[known] = np.arange(len(known))
    order = sorted(range(len(texts)), key=lambda k: len(b) - len(texts[k]))
    for first in range(0, len(order), _LANES):
        at = np.array(order[first : first + _LANES])
        n, limit = np.array([len(texts[k]) for k in at]), np.array([most[k] for k in at])
        keep = len(b) - n <= limit
        gone = at[~keep].tolist()
        at, n, limit = at[keep], n[keep], limit[keep]
        if len(at) > 4:
            own = np.stack([number[_codes(texts[k][: int(n.min())]).astype(np.uint16)] for k in at])
            gone += _beyond(codes, known, own, at, len(b) - n, limit)
        for k in gone:
            passed[k] = False
    return passed


def _beyond(codes: np.ndarray, known: np.ndarray, own: np.ndarray, at: np.ndarray, longer: np.ndarray, limit: np.ndarray) -> list[int]:
    """Those of ``at`` whose texts (rows of ``own``) have no way within their limit; the text of ``codes`` is longer by ``longer``."""
    gone: list[int] = []
    half, top, steps = int(((limit - longer) // 2).max()), int((longer + (limit - longer) // 2).max()), own.shape[1]
    width = top + half + 1
    size = width // 8 + 1  # bytes of a lane, a bit free at least
    # Places of b beside a text's place, as bits: one copy for each shift within a byte.
    spread = np.zeros((8, len(known) + 1, (steps + 7) // 8 + size + 1), np.uint8)
    bits = np.zeros((len(known), half + len(codes) + 8), bool)
    bits[:, half : half + len(codes)] = codes == known[:, None]
    for shift in range(8):
        packed = np.packbits(bits[:, shift:], axis=1, bitorder="little")[:, : spread.shape[2]]
        spread[shift, :-1, : packed.shape[1]] = packed

    def joined(lane: int | np.ndarray, n: int = 1) -> int:
        return int.from_bytes(lane.to_bytes(size, "little") * n if isinstance(lane, int) else lane.tobytes(), "little")

    def lanes(x: int) -> np.ndarray:
        return np.frombuffer(x.to_bytes(len(at) * size, "little"), np.uint8).reshape(-1, size)

    def apart(x: int) -> np.ndarray:
        return np.unpackbits(lanes(x), axis=1, count=width, bitorder="little").astype(np.int8)

    full, last = joined((1 << width) - 1, len(at)), joined(1 << (width - 1), len(at))
    up, down = joined((1 << width) - (1 << half), len(at)), 0
    rest, score = np.abs(longer[:, None] + half - np.arange(width)).astype(np.int32), np.full(len(at), top)
    # How often a lane's last diagonal cost one, as binary digits.
    digits: list[int] = []
    check = int(limit.min()) // 2 + 16
    for j in range(steps):
        eq = joined(spread[j & 7][:, j >> 3 : (j >> 3) + size].take(own[:, j], axis=0)) & full
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        plus = down | (full ^ (diagonal | up))
        more = last & ~diagonal
        up &= diagonal
        diagonal = (diagonal >> 1) & full
        down = diagonal & plus
        up |= full ^ (diagonal | plus)
        for k, digit in enumerate(digits):
            if not more:
                break
            digits[k], more = digit ^ more, digit & more
        if more:
            digits.append(more)
        if j < check and j + 1 < steps:
            continue
        for k, digit in enumerate(digits):
            score += (lanes(digit)[:, (width - 1) >> 3] >> ((width - 1) & 7) & 1).astype(np.int64) << k
        digits, check = [], j + _STEPS
        # Bit k holds the difference of the next place to this one.
        column = np.zeros((len(at), width), np.int32)
        np.cumsum((apart(up) - apart(down))[:, : width - 1], axis=1, dtype=np.int32, out=column[:, 1:])
        column += rest
        keep = column.min(axis=1) + score - (column[:, -1] - rest[:, -1]) <= limit
        if not keep.all():
            gone += at[~keep].tolist()
            up, down = joined(lanes(up)[keep]), joined(lanes(down)[keep])
            at, limit, score, rest, own = at[keep], limit[keep], score[keep], rest[keep], own[keep]
            full, last = joined((1 << width) - 1, len(at)), joined(1 << (width - 1), len(at))
            if len(at) <= 4:
                break
    return gone


_OVERLAP = "merged string, loc string"


def overlap_merge(a: Column | str, b: Column | str, min_score: int = 10, min_identity: float = 0.9) -> Column:
    """struct(merged, loc) of two flanks; both null if they don't overlap or one is null."""

    @F.pandas_udf(_OVERLAP)
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(merge_overlaps(x.tolist(), y.tolist(), min_score, min_identity), columns=["merged", "loc"])

    return run(col(a), col(b))


#: Scoring of inverted repeats.
IR_MATCH, IR_MISMATCH, IR_GAP, IR_THRESHOLD, IR_SPACER = 3, -4, -12, 15, 20
_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def _matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths): one row a text, 1 to 4 for A, C, G and T, 0 for any other character and past the end."""
    out = np.zeros((len(texts), max(map(len, texts), default=0)), np.uint8)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.encode("ascii", "replace"), np.uint8)
    return _BASE_CODES[out], np.array([len(t) for t in texts], np.int32)


_BASE_CODES = np.zeros(256, np.uint8)
for _k, _c in enumerate("ACGT"):
    _BASE_CODES[ord(_c)] = _k + 1


def inverted_repeat_batch(fives: list[str], threes: list[str], distance: int = 15) -> list[tuple[str, str] | None]:
    """(5p arm, 3p arm) of the best inverted repeat near both outer ends of each pair, or None.

    A local alignment of the 5p terminus with the reverse complement of the 3p
    terminus, cell by cell for all pairs at once; N matches nothing.  Arms must begin
    within ``distance`` of the outer ends.  The longest 5p arm of the best score
    stands, first by place.
    """
    xs, ys = [x.upper() for x in fives], [y.upper()[::-1].translate(_COMPLEMENT) for y in threes]
    (x, nx), (y, ny) = _matrix(xs), _matrix(ys)
    rows, width = len(xs), y.shape[1]
    score = np.zeros((2, width + 1, rows), np.int32)
    begin = np.zeros((2, 2, width + 1, rows), np.int32)  # of the 5p arm, of the 3p arm
    big = max(x.shape[1], width) + 2
    best, place = np.zeros(rows, np.int64), np.zeros((4, rows), np.int32)
    for i in range(1, x.shape[1] + 1):
        was, now = (i - 1) % 2, i % 2
        score[now, 0] = 0
        inside = i <= nx
        for j in range(1, width + 1):
            same = (x[:, i - 1] == y[:, j - 1]) & (x[:, i - 1] > 0)
            over, up, left = score[was, j - 1] + np.where(same, IR_MATCH, IR_MISMATCH), score[was, j] + IR_GAP, score[now, j - 1] + IR_GAP
            top = np.maximum(np.maximum(over, up), left)
            live = (top > 0) & inside & (j <= ny)
            # Of equal moves the diagonal comes first, then the gap in the 3p arm.
            by_over, by_up = over == top, up == top
            a = np.where(by_over, np.where(score[was, j - 1] > 0, begin[was, 0, j - 1], i - 1), np.where(by_up, np.where(score[was, j] > 0, begin[was, 0, j], i - 1), np.where(score[now, j - 1] > 0, begin[now, 0, j - 1], i)))
            b = np.where(by_over, np.where(score[was, j - 1] > 0, begin[was, 1, j - 1], j - 1), np.where(by_up, np.where(score[was, j] > 0, begin[was, 1, j], j), np.where(score[now, j - 1] > 0, begin[now, 1, j - 1], j - 1)))
            score[now, j] = np.where(live, top, 0)
            begin[now, 0, j], begin[now, 1, j] = a, b
            # Places are counted from 1, as repeat finders print them.
            key = np.where(live & (top >= IR_THRESHOLD) & (a + 1 <= distance) & (b <= distance), (top.astype(np.int64) * big + (i - a)) * big + (big - a), 0)
            better = key > best
            if better.any():
                best[better] = key[better]
                for k, v in enumerate((a, i, b, j)):
                    place[k, better] = v[better] if isinstance(v, np.ndarray) else v
    return [(xs[k][a:i], threes[k].upper()[len(ys[k]) - j : len(ys[k]) - b]) if best[k] else None for k, (a, i, b, j) in enumerate(place.T.tolist())]


def inverted_repeat(five: str, three: str, distance: int = 15) -> tuple[str, str] | None:
    """The inverted repeat of one pair."""
    return inverted_repeat_batch([five], [three], distance)[0]


def _repeats(x: pd.Series, y: pd.Series, distance: int, step: int = 2048) -> pd.DataFrame:
    out: list[tuple] = [(None, None)] * len(x)
    known = [k for k, (p, q) in enumerate(zip(x, y, strict=True)) if p is not None and q is not None]
    known.sort(key=lambda k: (len(x.iloc[k]), len(y.iloc[k])))
    for a in range(0, len(known), step):
        part = known[a : a + step]
        for k, found in zip(part, inverted_repeat_batch([x.iloc[k] for k in part], [y.iloc[k] for k in part], distance), strict=True):
            out[k] = found or (None, None)
    return pd.DataFrame(out, columns=["IR_5p", "IR_3p"])


def inverted_repeats(five: Column | str, three: Column | str, distance: int = 15) -> Column:
    """struct(IR_5p, IR_3p), null where there is none."""

    @F.pandas_udf("IR_5p string, IR_3p string")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return _repeats(x, y, distance)

    return run(col(five), col(three))


def register_all(spark: SparkSession) -> None:
    """SQL functions: gl_revcomp, gl_canonical, gl_overlap, gl_inverted_repeat, and gl_consensus of one site's words and qualities.

    gl_consensus(collect_list(word), collect_list(quals)) gives the site's clusters as
    array<struct<consensus, n_reads>>; a null word is left out.
    """
    define = "CREATE OR REPLACE TEMPORARY FUNCTION"
    upper = f"translate(s, '{_LOWER}', '{_UPPER}')"
    spark.sql(f"{define} gl_revcomp(s STRING) RETURNS STRING RETURN translate(reverse({upper}), 'ACGT', 'TGCA')")
    spark.sql(f"{define} gl_canonical(s STRING) RETURNS STRING RETURN least({upper}, translate(reverse({upper}), 'ACGT', 'TGCA'))")

    @F.pandas_udf(_OVERLAP)
    def overlap(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(merge_overlaps(x.tolist(), y.tolist(), 10, 0.9), columns=["merged", "loc"])

    @F.pandas_udf("IR_5p string, IR_3p string")
    def repeat(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return _repeats(x, y, 15)

    @F.pandas_udf("array<struct<consensus:string,n_reads:long>>")
    def consensus(words: pd.Series, quals: pd.Series) -> pd.Series:
        from ..operators.consensus import site_consensus

        def one(own, marks) -> list[dict]:
            sums: dict[str, list] = {}
            for w, q in zip(own if own is not None else [], marks if marks is not None else [], strict=False):
                if w is not None:
                    held = sums.setdefault(w, [[0] * len(w), 0])
                    held[0], held[1] = [a + int(b) for a, b in zip(held[0], q, strict=False)], held[1] + 1
            return [{"consensus": c, "n_reads": n} for c, n in site_consensus([(w, q, n) for w, (q, n) in sums.items()])]

        return pd.Series([one(w, q) for w, q in zip(words, quals, strict=True)])

    spark.udf.register("gl_consensus", consensus)
    spark.udf.register("gl_overlap", overlap)
    spark.udf.register("gl_inverted_repeat", repeat)
