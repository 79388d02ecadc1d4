"""Checks of arguments on the driver."""

from __future__ import annotations

import math

_TOP = 3.4028234663852886e38


def check_rect(rect) -> tuple[float, float, float, float]:
    r = tuple(float(v) for v in rect)
    if len(r) != 4 or not all(math.isfinite(v) and abs(v) <= _TOP for v in r) or r[0] >= r[2] or r[1] >= r[3]:
        raise ValueError("a rectangle needs four finite numbers in order")
    return r


def check_color(color) -> tuple[float, float, float]:
    c = tuple(float(v) for v in color)
    if len(c) != 3 or not all(0 <= v <= 1 for v in c):
        raise ValueError("a colour is three numbers from 0 to 1")
    return c
