"""Folds over arrays that gather a list, as SQL text.

Spark copies a fold's state at every step. A list in the state is therefore kept short:
items are folded in blocks of 16, blocks in blocks of 16 again, and only then on the whole.
"""

from __future__ import annotations

from collections.abc import Callable

_BLOCK = 16


def gather_sql(
    items: str, carry: dict[str, str], kind: str, step: Callable[[Callable[..., str]], str], last: str | None = None
) -> str:
    """SQL of ``array<kind>``: what the fold over the array ``items`` (a name) has put out.

    ``carry`` gives the first values of the state's fields. ``step(state)`` is the next state
    for the item ``x`` in state ``s``, made by ``state(out, field=...)``, where ``out`` is an
    array to put out and fields not named stay. ``last`` is put out at the end, of state ``e``.
    """
    none = f"cast(array() AS array<{kind}>)"

    def made(values: dict[str, str], out: str) -> str:
        return "named_struct(" + "".join(f"'{c}', {v}, " for c, v in values.items()) + f"'out', {out})"

    def state(out: str | None = None, **changes: str) -> str:
        values = {c: changes.get(c, f"s.{c}") for c in carry}
        return made(values, f"concat(s.out, {out})" if out else "s.out")

    def held(name: str) -> dict[str, str]:
        return {c: f"{name}.{c}" for c in carry}

    lists = f"array<array<{kind}>>"
    size = f"size({items})"
    inner = f"""aggregate(slice({items}, (j * {_BLOCK} + k) * {_BLOCK} + 1, {_BLOCK}), {made(held('b'), none)},
        (s, x) -> {step(state)}, d -> {made(held('d'), 'concat(b.out, array(d.out))')})"""
    middle = f"""aggregate(sequence(0, cast(least({_BLOCK - 1}, ({size} - j * {_BLOCK * _BLOCK}) div {_BLOCK}) AS int)),
        {made(held('a'), f'cast(array() AS {lists})')}, (b, k) -> {inner}, d -> {made(held('d'), 'concat(a.out, array(flatten(d.out)))')})"""
    end = f"flatten(concat(e.out, array({last})))" if last else "flatten(e.out)"
    return f"""aggregate(sequence(0, cast({size} div {_BLOCK * _BLOCK} AS int)), {made(carry, f'cast(array() AS {lists})')},
        (a, j) -> {middle}, e -> {end})"""
