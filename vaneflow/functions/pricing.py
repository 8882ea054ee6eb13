"""Prices, fees, fills, books and probabilities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEE_RATE = 0.05

# Order sizes that count as round lots.
ROUND_LOTS = (5, 10, 15, 20, 25, 30, 40, 50, 60, 75, 100, 125, 150, 200, 250, 500, 1000)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def fee_per_share(price, rate: float = FEE_RATE) -> Column:
    p = _c(price)
    return F.lit(rate) * p * (F.lit(1.0) - p)


def trade_pnl(price, won, rate: float = FEE_RATE) -> Column:
    """One share bought at `price`: payoff minus cost minus fee."""
    return _c(won).cast("double") - _c(price) - fee_per_share(price, rate)


def net_return(payoff, cost, fee: float = 0.02) -> Column:
    """Multiplicative-fee return; null when the cost is zero."""
    return F.try_divide(_c(payoff).cast("double"), _c(cost) * F.lit(1 + fee)) - 1


def short_return(outcome, price, half_spread: float = 0.03, fee: float = 0.02) -> Column:
    """Return of buying the other side after paying the half spread."""
    return net_return(F.lit(1) - _c(outcome), F.lit(1.0) - _c(price) + F.lit(half_spread), fee)


def mid(bid, ask) -> Column:
    return (_c(bid) + _c(ask)) / 2


def spread(bid, ask) -> Column:
    return _c(ask) - _c(bid)


def complement(price) -> Column:
    return F.lit(1.0) - _c(price)


def size_class(size) -> Column:
    s = _c(size)
    return (
        F.when(F.abs(s - F.rint(s)) > 0.001, "fractional")
        .when(F.rint(s).isin(*[float(x) for x in ROUND_LOTS]), "round")
        .when(s < 49.5, "small-odd")
        .otherwise("large-odd")
    )


def bands(value, edges: list[float], labels: list[str]) -> Column:
    """First label whose upper edge exceeds the value; the last label takes the rest."""
    v = _c(value)
    out = F.when(v < edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        out = out.when(v < edge, label)
    return F.when(v.isNotNull(), out.otherwise(labels[len(edges)]))


def forecast_spread(*forecasts, minimum: int | None = None) -> Column:
    """Max minus min over the forecasts, null when fewer than `minimum` (default all) are present."""
    cols = [_c(f) for f in forecasts]
    need = len(cols) if minimum is None else minimum
    present = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return F.when(present >= need, F.greatest(*cols) - F.least(*cols))


def fill_fields(maker_asset, taker_asset, maker_amount, taker_amount, yes_token, no_token) -> dict[str, Column]:
    """Taker view of a raw exchange event.  `price` is null for token swaps and zero amounts; drop those."""
    ma, ta = _c(maker_asset), _c(taker_asset)
    mq, tq = _c(maker_amount).cast("double"), _c(taker_amount).cast("double")
    buying, selling = ma == "0", (ma != "0") & (ta == "0")
    token = F.when(buying, ta).when(selling, ma)
    price = F.when(buying, F.try_divide(mq, tq)).when(selling, F.try_divide(tq, mq))
    shares = F.when(buying, tq).when(selling, mq) / 1e6
    outcome = F.when(token == _c(yes_token), "YES").when(token == _c(no_token), "NO").otherwise("UNKNOWN")
    side = F.when(buying, "buy").when(selling, "sell")
    return {"token_id": token, "outcome": outcome, "side": side, "price": price, "shares": shares, "usd": price * shares}


# Level arrays: array<struct<price, size>>.

def best_bid(levels) -> Column:
    return F.array_max(F.filter(F.transform(_c(levels), lambda x: x["price"].try_cast("double")), lambda p: p.isNotNull()))


def best_ask(levels) -> Column:
    return F.array_min(F.filter(F.transform(_c(levels), lambda x: x["price"].try_cast("double")), lambda p: p.isNotNull()))


def level_count(levels) -> Column:
    return F.size(F.filter(F.coalesce(_c(levels), F.array()), lambda x: x["price"].try_cast("double").isNotNull()))


def size_where(levels, keep) -> Column:
    """Total size over the levels that satisfy `keep(price)`."""
    picked = F.filter(_c(levels), lambda x: keep(x["price"].cast("double")))
    return F.aggregate(picked, F.lit(0.0), lambda acc, x: acc + x["size"].cast("double"))


def bid_depth_within(levels, distance: float) -> Column:
    best = best_bid(levels)
    return size_where(levels, lambda p: p >= best - F.lit(distance) - F.lit(1e-9))


def ask_depth_within(levels, distance: float) -> Column:
    best = best_ask(levels)
    return size_where(levels, lambda p: p <= best + F.lit(distance) + F.lit(1e-9))


def takeable(asks, ceiling) -> Column:
    return size_where(asks, lambda p: p <= _c(ceiling))


# Published coefficients of the error function's three rational forms, highest power first
# (W. J. Cody, Math. Comp. 23, 1969).
ERF_SMALL = (
    (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
ERF_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2,
     8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
     3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
ERF_FAR = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
     1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242, 1.87295284992346047, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _ratio(v: Column, forms) -> Column:
    def horner(cs) -> Column:
        out = F.lit(cs[0])
        for c in cs[1:]:
            out = out * v + F.lit(c)
        return out

    return horner(forms[0]) / horner(forms[1])


def with_normal_cdf(df: DataFrame, **scores: Column) -> DataFrame:
    """Add the standard normal CDF of each score (infinities allowed) to about 1e-15.

    Spark has no error function.  The shared parts are columns of their own, so each is computed once
    and the expressions stay small enough for code generation."""
    names = list(scores)
    out = df.withColumns({f"_z_{n}": c.cast("double") for n, c in scores.items()})
    out = out.withColumns({f"_a_{n}": F.least(F.abs(F.col(f"_z_{n}")) / math.sqrt(2.0), F.lit(26.0)) for n in names})
    out = out.withColumns({f"_s_{n}": F.col(f"_a_{n}") * F.col(f"_a_{n}") for n in names})
    out = out.withColumns({f"_e_{n}": F.exp(-F.col(f"_s_{n}")) for n in names} | {f"_i_{n}": F.try_divide(F.lit(1.0), F.col(f"_s_{n}")) for n in names})
    tails = {}
    for n in names:
        a, sq, ex, inv = (F.col(f"_{k}_{n}") for k in "asei")
        far = F.try_divide(ex, a) * (F.lit(1 / math.sqrt(math.pi)) - inv * _ratio(inv, ERF_FAR))
        tails[f"_t_{n}"] = F.when(a <= 0.46875, F.lit(1.0) - a * _ratio(sq, ERF_SMALL)).when(a <= 4.0, ex * _ratio(a, ERF_MIDDLE)).otherwise(far)
    out = out.withColumns(tails)
    cdf = {n: F.when(F.col(f"_z_{n}") >= 0, F.lit(1.0) - F.col(f"_t_{n}") / 2).otherwise(F.col(f"_t_{n}") / 2) for n in names}
    return out.withColumns(cdf).drop(*[f"_{k}_{n}" for n in names for k in "zaseit"])
