"""Counter-based random draws: a hash of seed, replication and place, the same on any engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 52


def bits(seed: int, *parts: Column | str) -> Column:
    """52 random bits for each combination of ``parts``."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def bits_sql(seed: int, *parts: str) -> str:
    """The DuckDB twin of ``bits``."""
    text = " || ':' || ".join([f"'{seed}'", *[f"({p})::VARCHAR" for p in parts]])
    return f"('0x' || substr(md5({text}), 1, {BITS // 4}))::BIGINT"


def uniform(seed: int, *parts: Column | str) -> Column:
    """In (0, 1)."""
    return (bits(seed, *parts) + F.lit(0.5)) / F.lit(float(1 << BITS))


def uniform_sql(seed: int, *parts: str) -> str:
    return f"(({bits_sql(seed, *parts)} + 0.5E0) / {float(1 << BITS):.1f}E0)"


def normal(seed: int, *parts: Column | str) -> Column:
    """Standard normal by Box and Muller."""
    u, v = uniform(seed, *parts), uniform(seed + 1, *parts)
    return F.sqrt(F.log(u) * F.lit(-2.0)) * F.cos(v * F.lit(6.283185307179586))


def normal_sql(seed: int, *parts: str) -> str:
    return f"(sqrt(-2.0E0 * ln({uniform_sql(seed, *parts)})) * cos(6.283185307179586E0 * {uniform_sql(seed + 1, *parts)}))"


def cauchy(seed: int, *parts: Column | str) -> Column:
    return F.tan((uniform(seed, *parts) - 0.5) * F.lit(3.141592653589793))


def exponential(seed: int, *parts: Column | str) -> Column:
    return -F.log(uniform(seed, *parts))


def gamma_whole(seed: int, shape: int, *parts: Column | str) -> Column:
    """Gamma of a whole shape: a sum of exponentials."""
    return sum((exponential(seed + 2 * k, *parts) for k in range(1, shape)), exponential(seed, *parts))


def beta_whole(seed: int, a: int, b: int, *parts: Column | str) -> Column:
    """Beta of whole parameters: a share of two gammas."""
    x, y = gamma_whole(seed, a, *parts), gamma_whole(seed + 1000, b, *parts)
    return x / (x + y)


def sphere(seed: int, dims: int, *parts: Column | str) -> Column:
    """A point on the unit sphere, as an array."""
    z = [normal(seed + 10 * k, *parts) for k in range(dims)]
    length = F.sqrt(sum((c * c for c in z[1:]), z[0] * z[0]))
    return F.array(*[c / length for c in z])


#: Candidates of a round of rejection; a row that accepts none of them takes the sum of its parts, which has the same distribution.
TRIES = 16


def gamma_half(seed: int, v: int, *parts: Column | str) -> Column:
    """Gamma of shape v / 2.

    Shapes over 1 take the first accepted of ``TRIES`` candidates on a tangent
    curve, whose number does not grow with the shape. Whatever happened to the
    candidates, a sum of exponentials and half a squared normal is as good a draw,
    so rows without an accepted one take that from draws of their own.
    """
    whole = gamma_whole(seed + 100, v // 2, *parts) if v > 1 else F.lit(0.0)
    if v % 2:
        z = normal(seed + 90, *parts)
        whole = whole + z * z / 2
    if v < 3:
        return whole
    less, root = v / 2 - 1, (v - 1) ** 0.5

    def candidate(k: int) -> Column:
        """The candidate if it is accepted; ``y`` is drawn once, whatever it is used for."""
        y = F.tan(uniform(seed, *parts, F.lit(k)) * F.lit(3.141592653589793))
        x = lambda y: y * root + less
        bound = lambda y: (y * y + 1) * F.exp(F.log(F.greatest(x(y), F.lit(1e-300)) / less) * less - y * root)
        return F.element_at(F.transform(F.array(y), lambda y: F.when((x(y) > 0) & (uniform(seed + 1, *parts, F.lit(k)) <= bound(y)), x(y))), 1)

    return F.coalesce(*[candidate(k) for k in range(TRIES)], whole)  # draws end with the first accepted


def gamma_half_sql(seed: int, v: int, *parts: str) -> str:
    """The DuckDB twin of ``gamma_half``."""
    terms = [f"(-ln({uniform_sql(seed + 100 + 2 * k, *parts)}))" for k in range(v // 2)]
    if v % 2:
        terms.append(f"pow({normal_sql(seed + 90, *parts)}, 2) / 2")
    whole = f"({' + '.join(terms)})"
    if v < 3:
        return whole
    less, root = v / 2 - 1, (v - 1) ** 0.5
    y = f"tan({uniform_sql(seed, *parts, 'k')} * 3.141592653589793)"
    x = f"(c.y * {root!r} + {less!r})"
    bound = f"(c.y * c.y + 1) * exp(ln(greatest({x}, 1e-300) / {less!r}) * {less!r} - c.y * {root!r})"
    tried = f"list_transform(range({TRIES}), lambda k: {{'y': {y}, 'u': {uniform_sql(seed + 1, *parts, 'k')}}})"
    return f"coalesce(list_transform(list_filter({tried}, lambda c: {x} > 0 AND c.u <= {bound}), lambda c: {x})[1], {whole})"


def beta_half(seed: int, v1: int, v2: int, *parts: Column | str) -> Column:
    """Beta of parameters v1 / 2 and v2 / 2: a share of two gammas."""
    x, y = gamma_half(seed, v1, *parts), gamma_half(seed + 1000, v2, *parts)
    return x / (x + y)


def beta_half_sql(seed: int, v1: int, v2: int, *parts: str) -> str:
    x, y = gamma_half_sql(seed, v1, *parts), gamma_half_sql(seed + 1000, v2, *parts)
    return f"({x} / ({x} + {y}))"
