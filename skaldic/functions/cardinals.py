"""Danish cardinal words for whole numbers, from the ordinary grammar of Danish numerals."""

from __future__ import annotations

from functools import lru_cache

# Danish numerals.
SMALL = (
    "nul en to tre fire fem seks syv otte ni ti elleve tolv tretten fjorten femten seksten sytten atten nitten"
).split()
TENS = "tyve tredive fyrre halvtreds tres halvfjerds firs halvfems".split()
LONG_SCALE = "m b tr kvadr kvint sekst sept okt non dec".split()
GROUPS = [(10 ** (6 * k + 3 * half), f"{stem}illi{('on', 'ard')[half]}") for k, stem in enumerate(LONG_SCALE, 1) for half in (0, 1)][::-1]
LIMIT = GROUPS[0][0] * 1000


def _below_hundred(n: int) -> str:
    if n < 20:
        return SMALL[n]
    tens, unit = TENS[n // 10 - 2], n % 10
    return f"{SMALL[unit]}og{tens}" if unit else tens


def _counter(n: int) -> str:
    """How many hundreds or thousands: one is neuter there."""
    return "et" if n == 1 else _spell(n)


def _spell(n: int) -> str:
    if n < 100:
        return _below_hundred(n)
    if n < 1000:
        head, rest = _counter(n // 100) + "hundrede", n % 100
        return f"{head} og {_below_hundred(rest)}" if rest else head
    for size, name in GROUPS:
        if n >= size:
            count, rest = divmod(n, size)
            head = f"{_spell(count)} {name if count == 1 else name + 'er'}"
            return f"{head} {_spell(rest)}" if rest else head
    head, rest = _counter(n // 1000) + "tusinde", n % 1000
    if not rest:
        return head
    return f"{head} og {_spell(rest)}" if rest < 100 else f"{head} {_spell(rest)}"


@lru_cache(maxsize=65536)
def cardinal(token: str) -> str:
    """The words of a token of digits; leading zeros don't count; beyond ``LIMIT`` the token stays."""
    try:
        n = int(token)
    except ValueError:
        return token
    return _spell(n) if 0 <= n < LIMIT else token
