"""Spans as arrays of (entity_type, start, end, score): code points, half open.

Expressions of this library are built as SQL text and parsed once (``F.expr``): a rule is a few thousand nodes, and
making each of them from Python costs a call to the JVM. So functions here take and give SQL text. ``let`` names a value
within an expression; ``pin`` makes a column of it.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<entity_type:string,start:int,end:int,score:double>"
SPANS = f"array<{SPAN}>"
HIT = "struct<r:int,start:int,end:int,value:string>"
_MATCH = "struct<r:int,n:int,v:string>"
CHUNK = 16  # elements that a scan gathers before it adds them to the next level, and of these to its result
PIECE = 256  # code points
_numbers = itertools.count()


def lit(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def var() -> str:
    """A new name for a lambda variable."""
    return f"v{next(_numbers)}"


def let(value: str, body: Callable[[str], str]) -> str:
    """``body`` with a name for ``value``, which is computed once.

    An aggregate of nothing, of which ``value`` is the start and ``body`` the end: unlike ``transform`` it copies no result.
    """
    v, same, x = var(), var(), var()
    return f"aggregate(array(), {value}, ({same}, {x}) -> {same}, {v} -> {body(v)})"


def each(rows: str, body: Callable[[str], str]) -> str:
    """All elements through ``body``."""
    v = var()
    return f"transform({rows}, {v} -> {body(v)})"


def keep(rows: str, condition: Callable[[str], str]) -> str:
    """The elements for which a condition holds."""
    v = var()
    return f"filter({rows}, {v} -> {condition(v)})"


def none(kind: str) -> str:
    """An empty array of a type of elements."""
    return f"cast(array() as array<{kind}>)"


def scan(rows: str, first: str, kind: str, step: Callable[[str, str], tuple[str, str | None]]) -> str:
    """Go through ``rows`` with a carried value: ``step`` of it and a row gives the next and a result, which may be null.

    Gives (c, o): the last carried value and all results but nulls; None for a result is the carried value itself. A fold
    copies all it carries at each step, so results are gathered in three levels: CHUNK rows, CHUNK of these, and all, as
    arrays of arrays; rows are taken by place, as ``slice`` copies, too. A result is so copied CHUNK times or so, and once
    more for each 2 * CHUNK * CHUNK rows. Up to CHUNK rows are one chunk. Keep results slim.
    """

    def run(all_rows: str) -> str:
        def part(places: str, start: str, by_place: bool) -> str:
            acc, i = var(), var()

            def moved(x: str) -> str:
                carry, out = step(f"{acc}.c", x)
                if out is None:
                    return let(carry, lambda c: f"named_struct('c', {c}, 'o', array_append({acc}.o, {c}))")
                added = let(out, lambda o: f"CASE WHEN {o} IS NULL THEN {acc}.o ELSE array_append({acc}.o, {o}) END")
                return f"named_struct('c', {carry}, 'o', {added})"

            body = let(f"{all_rows}[{i}]", moved) if by_place else moved(i)
            return f"aggregate({places}, named_struct('c', {start}, 'o', {none(kind)}), ({acc}, {i}) -> {body})"

        last = f"size({all_rows}) - 1"

        def level(places: str, start: str, width: int) -> str:
            """The blocks of ``width`` rows with these numbers, one after the other."""
            done, k = var(), var()
            within = lambda n: f"sequence({k} * {CHUNK}, least({k} * {CHUNK} + {CHUNK - 1}, cast(({last}) div {n} as int)))"
            inner = part(within(1), f"{done}.c", True) if width == CHUNK else level(within(width // CHUNK), f"{done}.c", width // CHUNK)
            both = let(inner, lambda p: f"named_struct('c', {p}.c, 'o', array_append({done}.o, {p}.o))")
            end = f"{done} -> named_struct('c', {done}.c, 'o', flatten({done}.o))"
            return f"aggregate({places}, named_struct('c', {start}, 'o', {none(f'array<{kind}>')}), ({done}, {k}) -> {both}, {end})"

        block = CHUNK * CHUNK
        whole = level(f"sequence(0, cast(({last}) div {block} as int))", first, block)
        return f"CASE WHEN size({all_rows}) > {CHUNK} THEN {whole} ELSE {part(all_rows, first, False)} END"

    return let(rows, run)


def joined(rows: str, kind: str, step: Callable[[str, str], tuple[str, str]]) -> str:
    """Scan with the last element open: ``step`` of it and the next gives a new open one and a closed one, which may be null."""

    def start(open_: str, x: str) -> tuple[str, str]:
        carry, closed = step(open_, x)
        return f"CASE WHEN {open_} IS NULL THEN {x} ELSE {carry} END", f"CASE WHEN {open_} IS NOT NULL THEN {closed} END"

    return let(scan(rows, f"cast(null as {kind})", kind, start), lambda r: f"CASE WHEN {r}.c IS NULL THEN {r}.o ELSE array_append({r}.o, {r}.c) END")


def pin(df: DataFrame, name: str, value: str | Column) -> DataFrame:
    """Add a column that is computed once, whatever later steps do with it.

    A plain column's expression would be copied into filters above it and into lambdas. A generator of one row keeps it
    in one place, and filters on other columns still pass below it, down to the scan.
    """
    rest = [c for c in df.columns if c.lower() != name.lower()]
    value = F.expr(value) if isinstance(value, str) else value
    return df.select(*[F.col(f"`{c}`") for c in rest], F.explode_outer(F.array(value)).alias(name))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores: for rows of few bytes and much work, which a scan, cut by bytes, leaves in one task.

    Put it below what adds columns, where rows are narrow. Filters above it still reach the scan.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def span(entity: str, start: str, end: str, score: str) -> str:
    """One span; ``entity`` is SQL text, too."""
    return f"named_struct('entity_type', {entity}, 'start', cast({start} as int), 'end', cast({end} as int), 'score', cast({score} as double))"


def pieces(text: str) -> str:
    """A text in pieces of PIECE code points: places in it are found without counting from its begin."""
    return f"regexp_extract_all({text}, {lit(f'(?s).{{1,{PIECE}}}')}, 0)"


def cut(parts: str, start: str, size: str) -> str:
    """``size`` code points from ``start`` of a text in ``pieces``."""
    first, last = f"cast(({start}) div {PIECE} as int)", f"cast(({start} + greatest({size}, 0)) div {PIECE} as int)"
    joint = f"CASE WHEN {first} = {last} THEN coalesce(get({parts}, {first}), '') ELSE array_join(transform(sequence({first}, {last}), k -> get({parts}, k)), '') END"
    return f"substring({joint}, ({start}) % {PIECE} + 1, greatest({size}, 0))"


def hits(text: str, patterns: list[tuple[str, int, str | None]]) -> str:
    """All matches of Java patterns (pattern, group, condition), as (r, start, end, value): r is the pattern's place in the list.

    With a group, that group is the hit; it must end the match. A pattern is only tried where its condition holds. Gaps
    (``split``) and matches alternate, so their lengths give exact code-point offsets; one scan of lengths does it for all.
    """
    parts = []
    for r, (pattern, group, when) in enumerate(patterns):
        p = lit(pattern)
        found = f"regexp_extract_all({text}, {p}, 0)"
        rows = f"zip_with(split({text}, {p}, -1), {found}, (g, m) -> named_struct('r', {r}, 'n', length(g) + length(m), 'v', m))"
        if group:
            rows = f"zip_with({rows}, regexp_extract_all({text}, {p}, {group}), (x, v) -> named_struct('r', {r}, 'n', x.n, 'v', v))"
        parts.append(f"CASE WHEN {f'{when} AND ' if when else ''}{text} rlike {p} THEN {rows} ELSE {none(_MATCH)} END")

    def some(rows: str) -> str:
        # a pattern's first length is written as -1 - n: there the sum begins anew
        lengths = f"transform({rows}, (x, i) -> CASE WHEN i > 0 AND {rows}[greatest(i - 1, 0)].r = x.r THEN x.n ELSE -1 - x.n END)"
        ends = f"{scan(lengths, '0', 'int', lambda c, n: (f'CASE WHEN {n} < 0 THEN -1 - {n} ELSE {c} + {n} END', None))}.o"
        placed = lambda e: f"transform({rows}, (x, i) -> named_struct('r', x.r, 'start', {e}[i] - length(x.v), 'end', {e}[i], 'value', x.v))"
        return f"CASE WHEN size({rows}) > 0 THEN {let(ends, placed)} ELSE {none(HIT)} END"

    return let(keep(f"concat({', '.join(parts)})", lambda x: f"{x}.n IS NOT NULL"), some) if parts else none(HIT)


def around(parts: str, hit: str, reach: int = 50) -> str:
    """The text from ``reach`` before a hit to ``reach`` after it."""
    low = f"greatest({hit}.start - {reach}, 0)"
    return cut(parts, low, f"{hit}.end + {reach} - {low}")


#: A word, where no dictionary cuts Chinese text: a run of other letters and digits, or two Han characters.
_WORD, _BETWEEN = r"(?:[\p{L}\p{Nd}&&[^\p{IsHan}]]++|\p{IsHan}{1,2}+)", r"[^\p{L}\p{Nd}]*+"


def words_near(parts: str, hit: str, before: int, after: int, reach: int = 60) -> str:
    """The last ``before`` words ahead of a hit and the first ``after`` behind it, within ``reach`` characters, lower-cased.

    Those ahead are taken from the reversed text, so the pattern is tried at one place: runs of letters, and of Han characters
    in twos, make as many words from either end.
    """
    low = f"greatest({hit}.start - {reach}, 0)"
    left = f"reverse(regexp_extract(reverse({cut(parts, low, f'{hit}.start - {low}')}), {lit(f'^(?:{_BETWEEN}{_WORD}){{0,{before}}}')}, 0))"
    right = f"regexp_extract({cut(parts, f'{hit}.end', str(reach))}, {lit(f'^(?:{_BETWEEN}{_WORD}){{0,{after}}}')}, 0)"
    return f"lower(concat({left if before else lit('')}, '\\n', {right if after else lit('')}))"


def shortest(words: tuple[str, ...]) -> tuple[str, ...]:
    """The words without those that hold another of them: a text with any of the ones has any of the others."""
    return tuple(w for w in dict.fromkeys(words) if not any(o in w for o in words if o != w))


def has_any(text: str, words: tuple[str, ...]) -> str:
    """Whether any of the words is a substring. A word that holds another needs no look of its own."""
    words = shortest(words)
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")" if words else "false"


def mof_valid(digits: str) -> str:
    """Checksum of a business number: digit sums of weighted digits; 7 in the seventh place has two readings."""
    weights = (1, 2, 1, 2, 1, 2, 4, 1)  # fixed values
    parts = []
    for i, w in enumerate(weights, 1):
        x = f"(cast(substring({digits}, {i}, 1) as int) * {w})"
        parts.append(f"cast({x} div 10 as int) + {x} % 10")
    return let(" + ".join(parts), lambda t: f"({t} % 10 = 0 OR (substring({digits}, 7, 1) = '7' AND ({t} - 1) % 10 = 0))")
