"""Text builders for the oracle side: geometry over columns x0..x16, y0..y16, z0..z16."""

from __future__ import annotations

from ..functions.skeleton import J

P = tuple[str, str, str]


def pt(j: int | str) -> P:
    n = J[j] if isinstance(j, str) else j
    return f"x{n}", f"y{n}", f"z{n}"


def v_sub(a: P, b: P) -> P:
    return tuple(f"({p} - {q})" for p, q in zip(a, b))


def v_mid(a: P, b: P) -> P:
    return tuple(f"(0.5 * ({p} + {q}))" for p, q in zip(a, b))


def v_dot(a: P, b: P) -> str:
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(a, b)) + ")"


def v_norm(a: P) -> str:
    return f"sqrt{v_dot(a, a)}"


def dist(a, b) -> str:
    return v_norm(v_sub(pt(a) if not isinstance(a, tuple) else a, pt(b) if not isinstance(b, tuple) else b))


def between_vectors(u: P, v: P, floor: float = 0.0) -> str:
    den = f"({v_norm(u)} * {v_norm(v)})"
    return f"CASE WHEN {den} > {floor!r} THEN degrees(acos(greatest(-1.0, least(1.0, {v_dot(u, v)} / {den})))) END"


def angle(a, c, b, floor: float = 0.0) -> str:
    return between_vectors(v_sub(pt(a), pt(c)), v_sub(pt(b), pt(c)), floor)


def leg(side: str) -> str:
    return f"({dist(side + '_hip', side + '_knee')} + {dist(side + '_knee', side + '_ankle')})"


def mean2(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN ({a} + {b}) / 2 ELSE coalesce({a}, {b}) END"


SCALE = mean2(leg("left"), leg("right"))
