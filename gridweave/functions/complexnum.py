"""Complex numbers as pairs of double columns; Spark has no complex type."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x)


@dataclass(frozen=True)
class Cx:
    """re + j im. Operators build expressions; nothing is computed until Spark runs them."""

    re: Column
    im: Column

    @staticmethod
    def of(re, im=0.0) -> Cx:
        return Cx(_col(re), _col(im))

    @staticmethod
    def polar(magnitude, angle) -> Cx:
        m, a = _col(magnitude), _col(angle)
        return Cx(m * F.cos(a), m * F.sin(a))

    def __add__(self, o: Cx) -> Cx:
        return Cx(self.re + o.re, self.im + o.im)

    def __sub__(self, o: Cx) -> Cx:
        return Cx(self.re - o.re, self.im - o.im)

    def __neg__(self) -> Cx:
        return Cx(-self.re, -self.im)

    def __mul__(self, o) -> Cx:
        if not isinstance(o, Cx):
            return Cx(self.re * _col(o), self.im * _col(o))
        return Cx(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    def conj(self) -> Cx:
        return Cx(self.re, -self.im)

    def abs2(self) -> Column:
        return self.re * self.re + self.im * self.im

    def abs(self) -> Column:
        return F.sqrt(self.abs2())

    def angle(self) -> Column:
        return F.atan2(self.im, self.re)

    def inverse(self) -> Cx:
        """1 / z, and 0 where z is 0."""
        d = F.when(self.abs2() != 0, self.abs2())
        return Cx(F.coalesce(self.re / d, F.lit(0.0)), F.coalesce(-self.im / d, F.lit(0.0)))

    def __truediv__(self, o: Cx) -> Cx:
        return self * o.inverse()

    def columns(self, prefix: str) -> dict[str, Column]:
        return {f"{prefix}_re": self.re, f"{prefix}_im": self.im}


def cx(prefix: str) -> Cx:
    """The pair of columns ``prefix_re`` and ``prefix_im``."""
    return Cx(F.col(f"{prefix}_re"), F.col(f"{prefix}_im"))


def wrap(angle, half_open: bool = False) -> Column:
    """An angle in (-pi, pi], or in [-pi, pi) if ``half_open``."""
    a = _col(angle)
    if half_open:
        return F.pmod(a + F.pi(), 2 * F.pi()) - F.pi()
    return F.atan2(F.sin(a), F.cos(a))


def normalize_complex(text) -> Cx:
    """Mixed spellings as a pair: ``a+bi``, ``a-bj``, ``(a, b)``, ``[a, b]``, {real|re, imag|im} in JSON, or a real; null if none."""
    t = F.regexp_replace(_col(text), r"\s+", "")
    number = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    part = lambda pattern, k: F.nullif(F.regexp_extract(t, pattern, k), F.lit("")).cast("double")
    named = lambda *keys: F.coalesce(*[F.get_json_object(F.when(t.startswith("{"), t), f"$.{k}").try_cast("double") for k in keys])
    pair, sum_, real = rf"^[\[(]({number}),({number})[\])]$", rf"^\(?({number})([+-](?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[ij]\)?$", rf"^({number})$"
    lone = rf"^({number})[ij]$"
    re = F.coalesce(part(pair, 1), part(sum_, 1), part(real, 1), named("real", "re"), F.when(part(lone, 1).isNotNull(), 0.0))
    im = F.coalesce(part(pair, 2), part(sum_, 2), F.when(part(real, 1).isNotNull(), 0.0), named("imag", "im"), part(lone, 1))
    return Cx(re, im)
