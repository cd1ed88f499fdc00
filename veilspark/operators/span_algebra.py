"""Merging, conflicts, numbering, replacement and restoration of spans within a row, as SQL text.

All are sorts and scans, so a text's cost grows with the number of its spans (times its logarithm), not with the square.
Up to FEW spans are looked up in plain arrays instead, which gives the same at less cost.
"""

from __future__ import annotations

from collections.abc import Callable

from ..functions.spans import SPAN, cut, each, joined, keep, let, none, pieces, scan, span

DICT = "array<struct<original:string,entity_type:string,ordinal:int,placeholder:string>>"
TOKEN = "<[A-Z_]+_[0-9]+>"
FEW = 128
_VALUE = "struct<i:int,value:string,entity_type:string,first:int>"
_NUMBERED = "struct<i:int,value:string,entity_type:string,ordinal:int,new:boolean>"
_PLACED = "struct<i:int,value:string>"


def merge_touching(spans: str) -> str:
    """Join spans of one type that overlap or touch; result in order of type and place."""

    def step(p: str, s: str) -> tuple[str, str]:
        joins = f"{p}.entity_type = {s}.entity_type AND {s}.start <= {p}.end"
        both = span(f"{p}.entity_type", f"{p}.start", f"greatest({p}.end, {s}.end)", f"greatest({p}.score, {s}.score)")
        return f"CASE WHEN {joins} THEN {both} ELSE {s} END", f"CASE WHEN {joins} THEN null ELSE {p} END"

    meet = lambda a, b: f"{a}.entity_type = {b}.entity_type AND {b}.start <= {a}.end"
    return let(f"sort_array({spans})", lambda rows: f"CASE WHEN {_some_pair(rows, meet)} THEN {joined(rows, SPAN, step)} ELSE {rows} END")


def _some_pair(rows: str, holds: Callable[[str, str], str]) -> str:
    """Whether a condition holds for any two neighbours."""
    return f"size({rows}) > 1 AND exists(sequence(1, size({rows}) - 1), i -> {holds(f'{rows}[i - 1]', f'{rows}[i]')})"


def drop_persons_in_dates(spans: str) -> str:
    """Leave out PERSON spans inside a birth date."""

    def kept(every: str, dates: str) -> str:
        inside = lambda s: f"exists({dates}, d -> d.start <= {s}.start AND {s}.end <= d.end)"
        return keep(every, lambda s: f"NOT ({s}.entity_type = 'PERSON' AND {inside(s)})")

    return let(spans, lambda every: let(keep(every, lambda s: f"{s}.entity_type = 'TW_BIRTH_DATE'"), lambda dates: kept(every, dates)))


def drop_contained(spans: str) -> str:
    """Leave out spans inside another; of equal places the higher score stays, then the later type. Result by type and place.

    From left to right, wider and better spans first, a span is inside another if an earlier one ends no sooner: one
    running maximum, no pairs.
    """
    order = f"sort_array({each(spans, lambda s: f"named_struct('back', -{s}.start, 'end', {s}.end, 'score', {s}.score, 'entity_type', {s}.entity_type)")}, false)"
    rows = each(order, lambda s: span(f"{s}.entity_type", f"-{s}.back", f"{s}.end", f"{s}.score"))

    def step(p: str, s: str) -> tuple[str, str]:  # p: of all before, the one that ends last
        new = f"({p} IS NULL OR {s}.end > {p}.end OR {s} = {p})"
        return f"CASE WHEN {new} THEN {s} ELSE {p} END", f"CASE WHEN {new} THEN {s} END"

    return f"sort_array({scan(rows, f'cast(null as {SPAN})', SPAN, step)}.o)"


def clip_overlaps(spans: str) -> str:
    """Left to right, cut the lower score of two overlapping spans; what becomes empty goes."""
    order = f"sort_array({each(spans, lambda s: f"named_struct('start', {s}.start, 'end', {s}.end, 'entity_type', {s}.entity_type, 'score', {s}.score)")})"
    rows = each(order, lambda s: span(f"{s}.entity_type", f"{s}.start", f"{s}.end", f"{s}.score"))

    def step(p: str, s: str) -> tuple[str, str]:
        later = span(f"{s}.entity_type", f"greatest({p}.end, {s}.start)", f"{s}.end", f"{s}.score")
        shorter = span(f"{p}.entity_type", f"{p}.start", f"least({p}.end, {s}.start)", f"{p}.score")
        overlap = f"{s}.start < {p}.end"
        return f"CASE WHEN {overlap} AND {p}.score >= {s}.score THEN {later} ELSE {s} END", f"CASE WHEN {overlap} AND {p}.score < {s}.score THEN {shorter} ELSE {p} END"

    return keep(joined(rows, SPAN, step), lambda s: f"{s}.start < {s}.end")


def merge_over_spaces(parts: str, spans: str) -> str:
    """Join neighbours of one type with nothing but spaces between; ``spans`` in order of place, ``parts`` the text in pieces."""

    def step(p: str, s: str) -> tuple[str, str]:
        joins = f"{p}.entity_type = {s}.entity_type AND {cut(parts, f'{p}.end', f'{s}.start - {p}.end')} rlike '^ +$'"
        both = span(f"{p}.entity_type", f"{p}.start", f"{s}.end", f"greatest({p}.score, {s}.score)")
        return f"CASE WHEN {joins} THEN {both} ELSE {s} END", f"CASE WHEN {joins} THEN null ELSE {p} END"

    near = lambda a, b: f"{a}.entity_type = {b}.entity_type AND {b}.start > {a}.end"
    return let(spans, lambda rows: f"CASE WHEN {_some_pair(rows, near)} THEN {joined(rows, SPAN, step)} ELSE {rows} END")


def resolve(text: str, spans: str) -> str:
    """The disjoint spans that replacement uses, in order of place."""

    def disjoint(s: str) -> str:
        """Spans that are disjoint as they are only need their order."""
        order = each(f"sort_array({each(s, lambda x: f"named_struct('start', {x}.start, 'span', {x})")})", lambda x: f"{x}.span")
        apart = lambda rows: f"forall({rows}, s -> s.start < s.end) AND NOT ({_some_pair(rows, lambda a, b: f'{b}.start < {a}.end')})"
        return let(order, lambda rows: f"CASE WHEN {apart(rows)} THEN {rows} ELSE {clip_overlaps(drop_contained(s))} END")

    some = lambda s: let(pieces(text), lambda parts: let(disjoint(s), lambda rows: merge_over_spaces(parts, rows)))
    return let(spans, lambda s: f"CASE WHEN size({s}) > 0 THEN {some(s)} ELSE {s} END")


def value_of(text: str, s: str) -> str:
    """The text of a span."""
    return f"substring({text}, {s}.start + 1, {s}.end - {s}.start)"


def numbered(values: str) -> str:
    """Each (value, entity_type) of a list with its number, in order: (i, value, entity_type, ordinal, new).

    A value has the type of its first place and is numbered among the values of that type in order of first places.
    """
    return let(values, lambda v: f"CASE WHEN size({v}) <= {FEW} THEN {numbered_few(v)} ELSE {numbered_many(v)} END")


def numbered_few(values: str) -> str:
    """``numbered`` for a short list: first places are looked up among the values, numbers among first places by type."""

    def run(firsts: str) -> str:
        heads = f"sort_array(transform(filter({firsts}, (f, i) -> f = i), f -> named_struct('entity_type', {values}[f].entity_type, 'first', f)))"
        kind = f"{values}[{firsts}[i]].entity_type"
        ordinal = lambda h: f"cast(array_position({h}.first, {firsts}[i]) - array_position({h}.entity_type, {kind}) + 1 as int)"
        return let(heads, lambda h: f"transform({values}, (x, i) -> named_struct('i', i, 'value', x.value, 'entity_type', {kind}, 'ordinal', {ordinal(h)}, 'new', {firsts}[i] = i))")

    return let(f"transform({values}, x -> cast(array_position({values}.value, x.value) - 1 as int))", run)


def numbered_many(values: str) -> str:
    """``numbered`` for any list: equal values meet by a sort; a second one, by type and first place, numbers them."""
    by_value = f"sort_array(transform({values}, (x, i) -> named_struct('value', x.value, 'i', i, 'entity_type', x.entity_type)))"

    def first(c: str, x: str) -> tuple[str, None]:
        known = f"({c}.value <=> {x}.value)"
        mine = f"named_struct('i', {x}.i, 'value', {x}.value, 'entity_type', CASE WHEN {known} THEN {c}.entity_type ELSE {x}.entity_type END, 'first', CASE WHEN {known} THEN {c}.first ELSE {x}.i END)"
        return mine, None

    placed = f"{scan(by_value, f'cast(null as {_VALUE})', _VALUE, first)}.o"
    by_type = f"sort_array({each(placed, lambda x: f"named_struct('entity_type', {x}.entity_type, 'first', {x}.first, 'i', {x}.i, 'value', {x}.value)")})"

    def ordinal(c: str, x: str) -> tuple[str, None]:
        new = f"({x}.i = {x}.first)"
        n = f"CASE WHEN {c}.entity_type <=> {x}.entity_type THEN {c}.ordinal + cast({new} as int) ELSE 1 END"
        mine = f"named_struct('i', {x}.i, 'value', {x}.value, 'entity_type', {x}.entity_type, 'ordinal', {n}, 'new', {new})"
        return mine, None

    return f"sort_array({scan(by_type, f'cast(null as {_NUMBERED})', _NUMBERED, ordinal)}.o)"


def _mark(x: str) -> str:
    return f"concat('<', {x}.entity_type, '_', {x}.ordinal, '>')"


def entries_of(numbers: str) -> str:
    """The dictionary of a text, in order of first places."""
    return each(keep(numbers, lambda x: f"{x}.new"), lambda x: f"named_struct('original', {x}.value, 'entity_type', {x}.entity_type, 'ordinal', {x}.ordinal, 'placeholder', {_mark(x)})")


def replaced(text: str, spans: str, reverse: bool = True) -> str:
    """(entries, anonymized): each of the disjoint, ordered ``spans`` replaced by its value's placeholder.

    ``reverse`` numbers from the end of the text, the order in which replacement by splicing works.
    """

    def run(parts: str) -> str:
        cuts = each(f"reverse({spans})" if reverse else spans, lambda s: f"named_struct('value', {cut(parts, f'{s}.start', f'{s}.end - {s}.start')}, 'entity_type', {s}.entity_type)")

        def put(numbers: str) -> str:
            number = f"{numbers}[size({numbers}) - 1 - i]" if reverse else f"{numbers}[i]"
            before = f"CASE WHEN i = 0 THEN 0 ELSE {spans}[greatest(i - 1, 0)].end END"
            filled = f"transform({spans}, (s, i) -> {let(before, lambda b: f'concat({cut(parts, b, f"s.start - {b}")}, {let(number, _mark)})')})"
            last = f"{spans}[size({spans}) - 1].end"
            tail = cut(parts, last, f"length({text}) - {last}")
            return f"named_struct('entries', {entries_of(numbers)}, 'anonymized', concat(array_join({filled}, ''), {tail}))"

        return let(let(cuts, numbered), put)

    empty = f"named_struct('entries', cast(array() as {DICT}), 'anonymized', {text})"
    return f"CASE WHEN size({spans}) > 0 THEN {let(pieces(text), run)} ELSE {empty} END"


def restore_once(text: str, entries: str) -> str:
    """Replace placeholders by ``entries`` (key: placeholder, value: original) in one pass: restored values are not read again.

    Of entries for one placeholder the last in order of values counts.
    """

    def run(marks: str) -> str:
        either = lambda e: f"CASE WHEN size({e}) <= {FEW} THEN {originals_few(marks, e)} ELSE {originals_many(marks, e)} END"
        return f"array_join(zip_with(split({text}, '{TOKEN}', -1), {let(entries, either)}, (g, o) -> concat(g, coalesce(o, ''))), '')"

    return f"CASE WHEN {text} rlike '{TOKEN}' THEN {let(f"regexp_extract_all({text}, '{TOKEN}', 0)", run)} ELSE {text} END"


def originals_few(marks: str, entries: str) -> str:
    """What stands for each mark, by looking it up among few entries; a mark without an entry stands for itself."""
    return let(f"sort_array({entries}, false)", lambda e: f"transform({marks}, m -> coalesce(get({e}.value, cast(array_position({e}.key, m) as int) - 1), m))")


def originals_many(marks: str, entries: str) -> str:
    """The same for any number of entries: marks and entries meet by a sort."""
    rows = f"concat({each(entries, lambda e: f"named_struct('token', {e}.key, 'i', -1, 'value', {e}.value)")}, transform({marks}, (m, i) -> named_struct('token', m, 'i', i, 'value', cast(null as string))))"

    def look(c: str, x: str) -> tuple[str, str]:
        known = f"{c}.token <=> {x}.token"
        return f"CASE WHEN {x}.i < 0 THEN named_struct('token', {x}.token, 'value', {x}.value) ELSE {c} END", f"CASE WHEN {x}.i >= 0 THEN named_struct('i', {x}.i, 'value', CASE WHEN {known} THEN coalesce({c}.value, {x}.token) ELSE {x}.token END) END"

    return f"sort_array({scan(f'sort_array({rows})', "cast(null as struct<token:string,value:string>)", _PLACED, look)}.o).value"


def as_entries(rows: str) -> str:
    """Dictionary entries as (key, value) for ``restore_once``."""
    return each(rows, lambda e: f"named_struct('key', {e}.placeholder, 'value', {e}.original)")


def replace_values(text: str, pairs: str) -> str:
    """Replace every occurrence of each (from, to) pair, longest ``from`` first, as plain text."""
    ranked = f"array_sort(filter({pairs}, e -> length(e.from) > 0), (a, b) -> length(b.from) - length(a.from))"
    return f"aggregate({ranked}, {text}, (t, e) -> replace(t, e.from, e.to))"
