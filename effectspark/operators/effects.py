"""Additive group effects: rating = mu + one effect per attribute + rest.

Effects are fitted one after the other, each on what the earlier ones left
over: ``b = sum(residual) / (n + lambda)`` per group. Joining every fitted
effect back to the log and aggregating again would read the log once per
effect. Here the log is read a fixed number of times:

* *wide* attributes (item, user: many values) take one pass each;
* all later attributes together take two. One pass sums the residual of the
  wide effects per value of each attribute, the other counts rows per pair of
  values. With ``N`` the pair counts, the k-th effect follows from tables of
  values alone::

      b_k[v] = (sum of residual in v - sum over j<k, u of N[u, v] * b_j[u]) / (n_v + lambda)

Both passes aggregate map-side to the number of values. An attribute that is
declared narrow but has too many values for that is found out and treated as wide.

While the table of a wide effect can be broadcast, nothing of the log's size is
shuffled. Beyond that, its join shuffles the log once: what is left over after it
is written, with the columns that later effects need, and the next passes go on
from there. Several lambdas are fitted at once as parallel columns, and several
folds at once through ``by``. Rows never stand in the log's size with a column per
lambda: the last wide effect is joined in the pass that sums them up. An effect with
few rows per value, as with many folds, is kept as sums by the first effect's counts,
from which it follows for every lambda.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from effectspark.functions import aggregates as A
from effectspark.operators.lookup import attach
from effectspark.operators.parts import PART, Parts
from effectspark.sources.store import Stored, Workspace

KEY_TYPES = (T.IntegralType, T.StringType)
FOUND = "__found_"
CARRIED = ("r", FOUND + "n", FOUND + "dev")  # of a rest after the first effect
RESERVED = ("b", "n", "s", "r", "c", "d", "m", "dev", "parts", "effect", "value")
MOST_PAIRS = 1 << 24  # rows that the table of value pairs may have
PART_BYTES = 24  # of a count, a sum and their place in a list
MOST_GROUPS = 1000  # values of ``by``: their means are kept in the plan


@dataclass(frozen=True)
class EffectSpec:
    """One attribute: ``wide`` if its values are too many to pair with others'."""

    name: str
    key: str
    wide: bool = False


ITEM = EffectSpec("item", "item_id", wide=True)
USER = EffectSpec("user", "user_id", wide=True)
RELEASE_YEAR = EffectSpec("release_year", "release_year")
REVIEW_YEAR = EffectSpec("review_year", "review_year")
REVIEW_MONTH = EffectSpec("review_month", "review_month")
REVIEW_MDAY = EffectSpec("review_mday", "review_mday")
REVIEW_WDAY = EffectSpec("review_wday", "review_wday")
REVIEW_HOUR = EffectSpec("review_hour", "review_hour")
AGE = EffectSpec("age", "age_at_review")
GENRES = EffectSpec("genres", "genres")

# The two orders in which the effects are fitted.
PLAIN_ORDER = (
    ITEM, USER, RELEASE_YEAR, REVIEW_YEAR, REVIEW_MONTH, REVIEW_MDAY, REVIEW_WDAY, AGE, GENRES, REVIEW_HOUR,
)
SHRUNK_ORDER = (
    ITEM, USER, RELEASE_YEAR, AGE, GENRES, REVIEW_WDAY, REVIEW_MONTH, REVIEW_HOUR, REVIEW_YEAR, REVIEW_MDAY,
)


@dataclass(frozen=True)
class EffectTable:
    """Effects per key value; columns ``by``, key, ``n``, and ``dev`` or ``b_*``.

    The first effect does not depend on earlier ones, so one column ``dev``
    (sum of deviations from the mean) serves every lambda. Right after it, what the first
    effect takes from a value's rows is a sum over the counts that these have in the first
    effect, ``d / (count + lambda)``; ``parts`` holds those counts and sums of deviations.
    """

    spec: EffectSpec
    stored: Stored
    shared_dev: bool
    in_parts: bool = False

    def payload(self, lambdas: Sequence[float]) -> list[str]:
        if self.in_parts:
            return ["m", "s", "parts"]
        return ["n", "dev"] if self.shared_dev else [_b(i) for i in range(len(lambdas))]

    def effect(self, i: int, lambda_: float, prefix: str = "") -> str:
        """The effect at the i-th lambda, as SQL text over the payload."""
        if self.shared_dev:
            return A.shrunk_sql(f"{prefix}dev", f"{prefix}n", lambda_)
        if self.in_parts:
            taken = f"aggregate({prefix}parts, 0D, (sum, x) -> sum + {A.shrunk_sql('x.d', 'x.n', lambda_)})"
            return A.shrunk_sql(f"({prefix}s - {taken})", f"{prefix}m", lambda_)
        return f"{prefix}{_b(i)}"


@dataclass(frozen=True)
class EffectModel:
    """Fitted effects for each lambda, and for each value of ``by`` if given."""

    specs: tuple[EffectSpec, ...]
    lambdas: tuple[float, ...]
    by: str | None
    mu: dict
    tables: tuple[EffectTable, ...]
    broadcast_bytes: int
    parts: Parts | None = None

    @property
    def on(self) -> list[str]:
        return [self.by] if self.by else []

    def mean(self) -> Column:
        """The training mean, per value of ``by``: one number, or one per fold."""
        return F.expr(self.mean_sql())

    def mean_sql(self) -> str:
        if not self.by:
            return A.double_sql(self.mu[None])
        cases = " ".join(f"WHEN {self.by} <=> {_literal(v)} THEN {A.double_sql(mu)}" for v, mu in self.mu.items())
        return f"CASE {cases} END" if cases else "CAST(NULL AS DOUBLE)"

    def table(self, name: str, lambda_: float | None = None) -> DataFrame:
        """Key, ``b`` and ``n`` of one effect."""
        i = 0 if lambda_ is None else self.lambdas.index(lambda_)
        found = next(t for t in self.tables if t.spec.name == name)
        return found.stored.df.select(
            *self.on, found.spec.key, F.expr(found.effect(i, self.lambdas[i])).alias("b"), "n"
        )

    def long(self) -> DataFrame:
        """All effects of the first lambda as (effect, key as text, b, n)."""
        parts = [
            self.table(s.name).select(
                *self.on, F.lit(s.name).alias("effect"), F.col(s.key).cast("string").alias("key"), "b", "n"
            )
            for s in self.specs
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def broadcasts(self, table: EffectTable) -> bool:
        """Whether the table and all smaller ones together stay within the broadcast limit."""
        size = lambda t: (t.stored.bytes, t.spec.name)
        return sum(t.stored.bytes for t in self.tables if size(t) <= size(table)) <= self.broadcast_bytes

    def brings(self, table: EffectTable) -> bool:
        """Whether the table is too large to broadcast but can be brought to the parts of the log."""
        return self.parts is not None and table.spec.key in self.parts.values and not self.broadcasts(table)

    def attach(self, rows: DataFrame, table: EffectTable) -> DataFrame:
        if self.brings(table) and PART in rows.columns:
            return self.parts.attach(rows, table.stored, table.spec.key, table.payload(self.lambdas), prefix=FOUND)
        limit = self.broadcast_bytes if self.broadcasts(table) else -1
        on = [*self.on, table.spec.key]
        return attach(rows, table.stored, on, table.payload(self.lambdas), limit, prefix=FOUND)


def _b(i: int) -> str:
    return f"b_{i}"


def _r(i: int) -> str:
    return f"r_{i}"


def _literal(value: object) -> str:
    """An integer, a text or NULL as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "decode(unhex('" + value.encode().hex() + "'), 'UTF-8')"
    return str(value)


def fit(
    frame: DataFrame,
    specs: Sequence[EffectSpec],
    ws: Workspace,
    lambdas: Sequence[float] = (0.0,),
    held: str | None = "is_val",
    by: str | None = None,
    parts: Parts | None = None,
) -> EffectModel:
    """Fit the effects in the given order on the rows that are not ``held`` out.

    ``frame`` is read several times; pass a stored table. Rows without a rating
    are left out; a NULL flag does not hold a row out. ``by`` fits every value of that
    column (a fold number: few values) on its own. Without specs the model is the
    mean alone. With ``parts``, whose ``frame`` is then the one to pass, effects too large
    to broadcast are brought to the parts of the log, which is not shuffled.
    """
    if parts and by:
        raise ValueError("parts serve one fit at a time: leave out either parts or by")
    specs, lambdas = tuple(specs), tuple(float(x) for x in lambdas)
    _check(frame, specs, lambdas, by)
    train = frame.filter("rating IS NOT NULL")
    train = train.filter(~F.coalesce(F.col(held), F.lit(False))) if held else train
    declared = specs
    specs = _widen(train, specs)
    model = EffectModel(specs, lambdas, by, {}, (), ws.broadcast_bytes, parts)
    last_wide = max((i for i, s in enumerate(specs) if s.wide), default=-1)
    narrow = specs[last_wide + 1 :]
    place = [PART] if parts else []

    counts = _pair_counts(train, [s.key for s in narrow], model) if len(narrow) > 1 else None
    with ws.saving(counts, "pair-counts") as pairs:
        rest: Rest | None = None
        for i, spec in enumerate(specs[: last_wide + 1]):
            later = [*(s.key for s in specs[i + 1 :]), *place]
            if rest is None:
                model = _fit_first(train, spec, model, ws)
                rest = Rest.start(train, model, [spec.key, *later])
            else:
                model = _with(model, _fit_wide(train, rest, spec, model, ws))
            rest = _move_on(rest, model, later, ws, last=i == last_wide)
        if not model.mu:
            model = replace(model, mu=_means(train, model.on, F.avg("rating")))
            rest = Rest.start(train, model, [s.key for s in narrow])
        model = _fit_narrow(train, rest, narrow, pairs, model, ws) if narrow else model
    return replace(model, specs=declared)


def _fit_wide(train: DataFrame, rest: Rest, spec: EffectSpec, model: EffectModel, ws: Workspace) -> EffectTable:
    """A wide effect on what the earlier ones left over."""
    rows = _rows_of_few(train, rest, spec, model, ws)
    if rows:
        stored = ws.save(_sums_in_parts(rest, spec.key, model), f"effect-{spec.name}")
        counted = stored.df.withColumn("m", F.col("n"))  # rows that the effect is joined to may have the first effect's n
        stored = replace(stored, df=counted, bytes=stored.bytes + rows * PART_BYTES)
        return EffectTable(spec, stored, shared_dev=False, in_parts=True)
    stored = ws.save(_shrunk_means(rest.final(model, [spec.key], spec.key), spec.key, model), f"effect-{spec.name}")
    return EffectTable(spec, stored, shared_dev=False)


def _rows_of_few(train: DataFrame, rest: Rest, spec: EffectSpec, model: EffectModel, ws: Workspace) -> int:
    """The rows of the log if a value has so few that they take less room than a column per lambda, else 0."""
    count = len(model.lambdas)
    if rest.carried != CARRIED or count <= 4:
        return 0
    value = F.struct(*model.on, spec.key)
    rows, values = train.agg(F.count(F.lit(1)), F.approx_count_distinct(value)).first()
    large = values * 8 * (count + len(model.on) + 3) > ws.broadcast_bytes
    return rows if large and 2 * rows < (count - 2) * values else 0


def _sums_in_parts(rest: Rest, key: str, model: EffectModel) -> DataFrame:
    """Per value: rows, sum of the deviations from the mean, and the first effect's deviations by its counts."""
    on, (r, n, dev) = [*model.on, key], CARRIED
    cells = rest.df.groupBy(*on, n).agg(F.count(F.lit(1)).alias("c"), F.sum(r).alias("s"), F.sum(dev).alias("d"))
    return cells.groupBy(*on).agg(
        F.sum("c").alias("n"), F.sum("s").alias("s"), F.expr(f"collect_list(named_struct('n', {n}, 'd', d))").alias("parts")
    )


def _move_on(rest: Rest, model: EffectModel, later: Sequence[str], ws: Workspace, last: bool) -> Rest:
    """Take the newest effect off; written out if its table is too large to be joined again and again.

    After the last wide effect one pass follows. With several lambdas it joins the effect itself:
    written rows would have a column per lambda.
    """
    table = model.tables[-1]
    rest = rest.minus(table, model, later)
    if not later or model.broadcasts(table) or model.brings(table):
        return rest
    if last and len(model.lambdas) > 1:
        return rest
    return replace(rest, df=ws.save(rest.df, f"rest-{table.spec.name}").df)


def _widen(train: DataFrame, specs: Sequence[EffectSpec]) -> tuple[EffectSpec, ...]:
    """Declare as wide what has too many values to be paired, by a count of each key's values."""
    last_wide = max((i for i, s in enumerate(specs) if s.wide), default=-1)
    narrow = specs[last_wide + 1 :]
    if len(narrow) < 2:
        return tuple(specs)
    counts = train.agg(*[F.approx_count_distinct(s.key).alias(f"d{i}") for i, s in enumerate(narrow)]).first()
    values = {s.key: counts[f"d{i}"] + 1 for i, s in enumerate(narrow)}
    left = list(narrow)
    while sum(values[a.key] * values[b.key] for j, b in enumerate(left) for a in left[:j]) > MOST_PAIRS:
        left.remove(max(left, key=lambda s: values[s.key]))
    return tuple(s if s.wide or s in left else replace(s, wide=True) for s in specs)


def _check(frame: DataFrame, specs: Sequence[EffectSpec], lambdas: Sequence[float], by: str | None) -> None:
    if not lambdas:
        raise ValueError("at least one lambda is needed")
    if min(lambdas) < 0:
        raise ValueError("lambda must not be negative")
    for key in [*(s.key for s in specs), *([by] if by else [])]:
        if key.lower() in RESERVED:
            raise ValueError(f"rename the column {key}: effect tables use that name themselves")
        if not isinstance(frame.schema[key].dataType, KEY_TYPES):
            raise TypeError(f"effect key {key} must be an integer or a string")


def _means(df: DataFrame, on: Sequence[str], mean: Column) -> dict:
    """The mean, as one number or one per fold."""
    found = df.groupBy(*on).agg(mean.alias("mu")).limit(MOST_GROUPS + 1).collect()
    if len(found) > MOST_GROUPS:
        raise ValueError(f"{on[0]} has more than {MOST_GROUPS} values")
    return {(r[on[0]] if on else None): r["mu"] for r in found}


def _fit_first(train: DataFrame, spec: EffectSpec, model: EffectModel, ws: Workspace) -> EffectModel:
    """Sum and count per key; the overall mean comes from the same table."""
    sums = train.groupBy(*model.on, spec.key).agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("s"))
    stored = ws.save(sums, f"sums-{spec.name}")
    model = replace(model, mu=_means(stored.df, model.on, F.sum("s") / F.sum("n")))
    deviations = stored.df.withColumn("dev", F.col("s") - F.col("n") * model.mean()).drop("s")
    return _with(model, EffectTable(spec, replace(stored, df=deviations), shared_dev=True))


def _shrunk_means(rest: DataFrame, key: str, model: EffectModel) -> DataFrame:
    grouped = rest.groupBy(*model.on, key).agg(F.count(F.lit(1)).alias("n"), *_sums(model))
    effects = [f"{A.shrunk_sql(_r(i), 'n', x)} AS {_b(i)}" for i, x in enumerate(model.lambdas)]
    return grouped.selectExpr(*model.on, key, "n", *effects)


def _sums(model: EffectModel) -> list[Column]:
    return [F.expr(f"sum({_r(i)}) AS {_r(i)}") for i in range(len(model.lambdas))]


def _with(model: EffectModel, table: EffectTable) -> EffectModel:
    return replace(model, tables=(*model.tables, table))


@dataclass(frozen=True)
class Rest:
    """Rows with what the effects so far leave over.

    Rows stay narrow for as long as two numbers stand for all lambdas: until then the
    residual of each lambda is an expression (``current``) over a few ``carried``
    columns. From the second effect on it is a column of its own.
    """

    df: DataFrame
    keys: tuple[str, ...]
    carried: tuple[str, ...]
    current: tuple[str, ...]

    @staticmethod
    def start(rows: DataFrame, model: EffectModel, keys: Sequence[str]) -> Rest:
        df = rows.selectExpr(*_unique(model.on, keys), f"rating - {model.mean_sql()} AS r")
        return Rest(df, tuple(keys), ("r",), ("r",) * len(model.lambdas))

    def minus(self, table: EffectTable, model: EffectModel, keys: Sequence[str]) -> Rest:
        """The rest after one more effect, with the columns that are needed further on."""
        effects = [table.effect(i, x, FOUND) for i, x in enumerate(model.lambdas)]
        current = tuple(f"{now} - coalesce({b}, 0D)" for now, b in zip(self.current, effects))
        joined = model.attach(self.df, table)
        if table.shared_dev:
            carried = (*self.carried, *(FOUND + p for p in table.payload(model.lambdas)))
            return Rest(joined.select(*_unique(model.on, keys, carried)), tuple(keys), carried, current)
        wide = tuple(_r(i) for i in range(len(model.lambdas)))
        return Rest(joined.selectExpr(*_unique(model.on, keys), *_named(current)), tuple(keys), wide, wide)

    def final(self, model: EffectModel, keep: Sequence[str], gather: str | None = None) -> DataFrame:
        """``by``, the ``keep`` columns and a residual per lambda.

        ``gather`` brings rows with equal values of that column together before they
        widen; the adaptive engine splits a popular value.
        """
        out = self.df.select(*_unique(model.on, keep, self.carried))
        if gather and len(model.lambdas) > 1:
            out = out.hint("rebalance", *model.on, gather)
        if self.current == tuple(_r(i) for i in range(len(model.lambdas))):
            return out
        return out.selectExpr(*_unique(model.on, keep), *_named(self.current))


def residuals(rows: DataFrame, model: EffectModel, keep: Sequence[str]) -> DataFrame:
    """``by``, the ``keep`` columns, and per lambda the rating minus all effects so far."""
    later = [t.spec.key for t in model.tables]
    rest = Rest.start(rows, model, [*keep, *later])
    for table in model.tables:
        later = later[1:]
        rest = rest.minus(table, model, [*keep, *later])
    return rest.final(model, keep)


def _named(residual: Sequence[str]) -> list[str]:
    return [f"{text} AS {_r(i)}" for i, text in enumerate(residual)]


def _unique(*names: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(n for group in names for n in group))


def _fit_narrow(
    train: DataFrame,
    rest: Rest,
    narrow: Sequence[EffectSpec],
    pairs: Callable[[], Stored | None],
    model: EffectModel,
    ws: Workspace,
) -> EffectModel:
    keys = [s.key for s in narrow]
    sums = ws.save(_value_sums(rest.final(model, keys), keys, model), "value-sums")
    return _fit_sums(train, sums, narrow, pairs, model, ws)


def _fit_sums(
    train: DataFrame,
    sums: Stored,
    narrow: Sequence[EffectSpec],
    pairs: Callable[[], Stored | None],
    model: EffectModel,
    ws: Workspace,
) -> EffectModel:
    """The narrow effects from value sums and pair counts; of ``train`` only the schema is taken."""
    types = {s.key: train.schema[s.key].dataType for s in narrow}
    solved: list[Stored] = []
    for k, spec in enumerate(narrow):
        stored = ws.save(_solve(k, sums, pairs(), solved, model, ws), f"effect-{spec.name}")
        solved.append(stored)
    for spec, stored in zip(narrow, solved):
        typed = stored.df.withColumn(spec.key, F.col("value").cast(types[spec.key])).drop("effect", "value")
        model = _with(model, EffectTable(spec, replace(stored, df=typed), shared_dev=False))
    return model


def _grouped_bits(m: int, *kept: int) -> int:
    """``grouping_id`` of a set that keeps these of ``m`` trailing columns."""
    return (1 << m) - 1 - sum(1 << (m - 1 - i) for i in kept)


def _value_sums(rest: DataFrame, keys: Sequence[str], model: EffectModel) -> DataFrame:
    """Long table (effect, by, value, n, r_*): residual sums per value of each key."""
    m, on = len(keys), model.on
    grouped = rest.groupingSets([[*on, k] for k in keys], *on, *keys).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), *_sums(model)
    )
    effect, value = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, k in enumerate(keys):
        here = F.col("gid") == _grouped_bits(m, i)
        effect = F.when(here, F.lit(i)).otherwise(effect)
        value = F.when(here, F.col(k).cast("string")).otherwise(value)
    return grouped.select(
        effect.alias("effect"), *on, value.alias("value"), "n", *[_r(i) for i in range(len(model.lambdas))]
    )


def _pair_counts(train: DataFrame, keys: Sequence[str], model: EffectModel) -> DataFrame:
    """Long table (earlier, later, by, from_value, value, pairs) over all key pairs."""
    m, on = len(keys), model.on
    couples = [(i, j) for j in range(m) for i in range(j)]
    grouped = (
        train.select(*on, *keys)
        .groupingSets([[*on, keys[i], keys[j]] for i, j in couples], *on, *keys)
        .agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("pairs"))
    )
    by_set = F.create_map(
        *[
            part
            for i, j in couples
            for part in (F.lit(_grouped_bits(m, i, j)).cast("bigint"), F.struct(F.lit(i), F.lit(j)))
        ]
    )
    which = F.element_at(by_set, F.col("gid"))
    texts = F.array(*[F.col(k).cast("string") for k in keys])
    return grouped.withColumn("which", which).select(
        F.col("which.col1").alias("earlier"),
        F.col("which.col2").alias("later"),
        *on,
        F.get(texts, F.col("which.col1")).alias("from_value"),
        F.get(texts, F.col("which.col2")).alias("value"),
        "pairs",
    )


def _solve(
    k: int, sums: Stored, pairs: Stored | None, solved: Sequence[Stored], model: EffectModel, ws: Workspace
) -> DataFrame:
    """The k-th narrow effect from value sums, pair counts and the earlier effects."""
    on, count = model.on, len(model.lambdas)
    own = sums.df.filter(F.col("effect") == k).drop("effect")
    if solved:
        match = ["earlier = __effect", "from_value <=> __value", *[f"{c} <=> __{c}" for c in on]]
        explained = pairs.df.filter(F.col("later") == k).join(
            _earlier(solved, ws, on, count), F.expr(" AND ".join(match))
        )
        taken = [f"-pairs * {_b(i)} AS {_r(i)}" for i in range(count)]
        own = (
            own.unionByName(explained.selectExpr(*on, "value", "0L AS n", *taken))
            .groupBy(*on, "value")
            .agg(F.sum("n").alias("n"), *_sums(model))
        )
    effects = [f"{A.shrunk_sql(_r(i), 'n', x)} AS {_b(i)}" for i, x in enumerate(model.lambdas)]
    return own.selectExpr(f"{k} AS effect", *on, "value", "n", *effects)


def _earlier(solved: Sequence[Stored], ws: Workspace, on: Sequence[str], count: int) -> DataFrame:
    """All solved effects as one table, broadcast if their measured size allows it."""
    df = ws.read([t.path for t in solved], solved[0].df.schema)
    table = replace(solved[0], df=df, rows=sum(t.rows for t in solved), bytes=sum(t.bytes for t in solved))
    return ws.small(table).selectExpr(
        "effect AS __effect", *[f"{c} AS __{c}" for c in on], "value AS __value", *[_b(i) for i in range(count)]
    )
