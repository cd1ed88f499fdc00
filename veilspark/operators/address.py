"""Addresses: tokens of nine tiers, joined into runs that go from large to small places."""

from __future__ import annotations

from ..functions.spans import SPAN, cut, each, hits, joined, keep, let, lit, none, pieces, span
from .rules import ADDRESS_GAP, ADDRESS_JOINTS, ADDRESS_SCORE, TIER_SIGNS, TIERS

_RUN = "struct<start:int,end:int,tier:int,many:boolean>"


def address_tokens(text: str, han: str) -> str:
    """(start, -end, tier) of all tokens, in order. ``han``: whether the text has Han characters; others are not searched."""
    tiers = f"array({', '.join(str(tier) for tier, _ in TIERS)})"
    rows = hits(text, [(p, 0, f"{han} AND {text} rlike {lit(TIER_SIGNS[tier])}") for tier, p in TIERS])
    return f"sort_array({each(rows, lambda h: f"named_struct('start', {h}.start, 'back', -{h}.end, 'tier', {tiers}[{h}.r])")})"


def address_spans(text: str, han: str) -> str:
    """Runs of strictly falling tiers with only separators between, if they have two tiers or more."""

    def runs(tokens: str, parts: str) -> str:
        run = lambda start, end, tier, many: f"named_struct('start', {start}, 'end', {end}, 'tier', {tier}, 'many', {many})"
        every = each(tokens, lambda t: run(f"{t}.start", f"-{t}.back", f"{t}.tier", "false"))

        def step(last: str, t: str) -> tuple[str, str]:
            gap = f"{t}.start - {last}.end"
            falls = f"{t}.tier < {last}.tier AND {gap} <= {ADDRESS_GAP} AND {cut(parts, f'{last}.end', gap)} rlike {lit(ADDRESS_JOINTS)}"
            longer = run(f"{last}.start", f"{t}.end", f"{t}.tier", "true")
            carry = f"CASE WHEN {t}.start < {last}.end THEN {last} WHEN {falls} THEN {longer} ELSE {t} END"
            return carry, f"CASE WHEN {t}.start < {last}.end OR {falls} THEN null ELSE {last} END"

        return each(keep(joined(every, _RUN, step), lambda r: f"{r}.many"), lambda r: span(lit("TW_ADDRESS"), f"{r}.start", f"{r}.end", str(ADDRESS_SCORE)))

    return let(address_tokens(text, han), lambda tokens: f"CASE WHEN size({tokens}) < 2 THEN {none(SPAN)} ELSE {let(pieces(text), lambda parts: runs(tokens, parts))} END")
