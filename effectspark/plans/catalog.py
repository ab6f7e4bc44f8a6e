"""The registered queries: each reads the tables of one scale-factor folder.

Measures are rounded to six places, because sums of doubles depend on order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from effectspark.operators import effects as E
from effectspark.operators import features, forest, label_effects, labels, parts, profile, scoring, sketches, split, tuning
from effectspark.operators.lookup import missing_rows
from effectspark.session import configure, size_shuffles
from effectspark.sources import delimited, model_store, standin
from effectspark.sources.store import Stored, session_workspace
from effectspark.streaming import lateness, learning, live

Query = Callable[[SparkSession, str], DataFrame]

KEY = list(standin.ROW_KEY)
LAMBDA = 5.0
FRACTION = 0.0375  # a fraction that is no thousandth
PLACES = 6
LABEL_WORDS = ("ECONOMY", "SMALL", "ring", "red")
KFOLD_GRID = (1.0, 5.0, 10.0)
KFOLD_ROWS = 1 << 20  # up to here all runs are fitted at once


def r6(value: Column | str) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, PLACES)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


class Run:
    """The frames a query starts from, for one session and folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = configure(spark), sf_dir
        self.ws = session_workspace(spark)
        size_shuffles(spark, self.ws.size([f"{sf_dir}/{t}.parquet" for t in standin.SCHEMAS]))

    def ratings(self) -> DataFrame:
        return standin.ratings(self.spark, self.dir)

    def items(self) -> DataFrame:
        return standin.items(self.spark, self.dir)

    def featured(self) -> DataFrame:
        return standin.featured(self.spark, self.dir)

    def flagged(self) -> DataFrame:
        return standin.with_holdout(self.ratings())

    def split(self) -> DataFrame:
        return standin.split_ratings(self.spark, self.dir, self.ws)

    def train(self) -> DataFrame:
        return self.split().filter(~F.col("is_val"))

    def train_featured(self) -> DataFrame:
        return features.add_all(delimited.fact_join(self.train(), self.items()))

    def frame(self, *extra: str) -> DataFrame:
        return self.stored_frame(*extra).df

    def stored_frame(self, *extra: str) -> Stored:
        """What a fit reads, written once for all queries of the session on this folder."""
        make = lambda: standin.model_frame(self.spark, self.dir, self.ws, *extra)
        return self.ws.kept("frame", (self.dir, *extra), [f"{self.dir}/{t}.parquet" for t in standin.SOURCES], make)

    def train_rows(self) -> DataFrame:
        """The training rows with the columns of the frame."""
        return self.frame().filter(~F.col("is_val"))

    def events(self) -> DataFrame:
        return standin.table(self.spark, self.dir, "events")


def query(make: Callable[[Run], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(Run(spark, sf_dir))


# sources


def src_ratings(run: Run) -> DataFrame:
    path = delimited.write_lines(run.ratings(), run.ws.path("ratings.dat"))
    return delimited.read_ratings(run.spark, path)


def src_items(run: Run) -> DataFrame:
    path = delimited.write_lines(run.items(), run.ws.path("items.dat"))
    return delimited.read_items(run.spark, path)


def fact_join(run: Run) -> DataFrame:
    return delimited.fact_join(run.ratings(), run.items())


# features


def feat_reviewed_at(run: Run) -> DataFrame:
    at = features.add_reviewed_at(run.ratings())
    return at.select(*KEY, F.col("reviewed_at").cast("timestamp_ntz").alias("reviewed_at"))


def feat_calendar(run: Run) -> DataFrame:
    return features.add_calendar(run.ratings()).select(*KEY, *features.CALENDAR)


def feat_release_year(run: Run) -> DataFrame:
    return features.add_release_year(run.items()).select("item_id", "title", "release_year")


def feat_release_year_regex(run: Run) -> DataFrame:
    return features.add_release_year(run.items(), method="regex").select("item_id", "title", "release_year")


def feat_age(run: Run) -> DataFrame:
    return run.featured().select(*KEY, "release_year", "review_year", "age_at_review")


def feat_all(run: Run) -> DataFrame:
    return run.featured().withColumn("reviewed_at", F.col("reviewed_at").cast("timestamp_ntz"))


def preview_features(run: Run) -> DataFrame:
    first = run.train().orderBy(*KEY).limit(10)
    shown = features.add_all(delimited.fact_join(first, run.items()))
    return features.preview(shown, [*KEY, "title", "release_year", "review_year", "age_at_review"], KEY)


def filter_unparsed_year(run: Run) -> DataFrame:
    return features.unparsed_year(run.train_featured()).select(*KEY, "title")


# split


def hashed(run: Run) -> DataFrame:
    """Rating rows with their hash, written once: exact splits read them several times."""
    return run.ws.save(run.flagged().select(*KEY, "rating", "h"), "hashed").df


def split_exact(run: Run) -> DataFrame:
    return split.exact_holdout(hashed(run), run.ws, "rating", "h", KEY)


def split_exact_fraction(run: Run) -> DataFrame:
    return split.exact_holdout(hashed(run), run.ws, "rating", "h", KEY, FRACTION)


def split_hash_fraction(run: Run) -> DataFrame:
    return run.flagged().select(*KEY, "h", split.holdout(F.col("h"), FRACTION).alias("held"))


def split_quantile(run: Run) -> DataFrame:
    """Exact holdout with strata of a continuous outcome: here the time of the rating."""
    rows = hashed(run)
    strata = rows.withColumn("stratum", split.quantile_strata(rows, "epoch_s", run.ws))
    return split.exact_flags(strata, run.ws, "stratum", "h", KEY, flag="held").select(*KEY, "stratum", "held")


def split_folds(run: Run) -> DataFrame:
    return tuning.cv_frame(run.train()).select(*KEY, "fold", "is_test")


def hashed_train(run: Run) -> DataFrame:
    return run.ws.save(run.train().select(*KEY, "rating", "h"), "train").df


def split_folds_exact(run: Run) -> DataFrame:
    return split.exact_folds(hashed_train(run), "rating", "h", KEY)


def split_inner_exact(run: Run) -> DataFrame:
    return tuning.stratified_cv_frame(hashed_train(run), run.ws, KEY).select(*KEY, "fold", "is_test")


def split_semi_item(run: Run) -> DataFrame:
    rows = run.flagged().select(*KEY, "temp")
    return split.in_both(rows.filter("temp"), rows.filter(~F.col("temp")), "item_id").select(*KEY)


def split_validation(run: Run) -> DataFrame:
    return run.split().filter("is_val").select(*KEY, "rating")


def split_returned(run: Run) -> DataFrame:
    return run.split().filter("temp AND NOT is_val").select(*KEY, "rating")


def split_returned_joins(run: Run) -> DataFrame:
    """The returned rows as an anti join: held out, and not in the validation set that joins give."""
    rows = run.ws.save(run.flagged().select(*KEY, "rating", "temp"), "flagged").df
    validation = split.protected_by_joins(rows)[1]
    return missing_rows(rows.filter("temp"), validation).select(*KEY, "rating")


def split_training(run: Run) -> DataFrame:
    return run.train().select(*KEY, "rating")


def split_protected(run: Run) -> DataFrame:
    return run.split().select(*KEY, "temp", "is_val")


# profiles of the training rows


def profile_summary(run: Run) -> DataFrame:
    return rounded(profile.summary(run.train_rows()), "mean_rating", "sd_rating")


def count_by_genres(run: Run) -> DataFrame:
    return profile.count_by_item_attribute(run.train(), run.items(), "genres")


def count_by_rating(run: Run) -> DataFrame:
    return profile.count_by(run.train_rows(), "rating").orderBy(F.col("n").desc(), "rating")


def top_titles(run: Run) -> DataFrame:
    counts = profile.count_by_item_attribute(run.train(), run.items(), "title", "ratings")
    return profile.top_k(counts, "ratings", ["title"], 10)


def profile_of(key: str) -> Query:
    return query(lambda run: rounded(profile.profile_by(run.train_rows(), key), "mean_rating"))


def profile_release_year(run: Run) -> DataFrame:
    items = features.add_release_year(run.items())
    out = profile.profile_by_item_attribute(run.train(), items, F.col("release_year"))
    return rounded(out, "mean_rating")


def profile_age(run: Run) -> DataFrame:
    items = features.add_release_year(run.items())
    age = (F.col("review_year") - F.col("release_year")).alias("age_at_review")
    rows = features.add_calendar(run.train())
    return rounded(profile.profile_by_item_attribute(rows, items, age, ["review_year"]), "mean_rating")


def profile_genres(run: Run) -> DataFrame:
    out = profile.profile_by_item_attribute(run.train(), run.items(), F.col("genres"))
    return rounded(out, "mean_rating")


def mean_of_user_means(run: Run) -> DataFrame:
    return rounded(profile.mean_of_means(run.train_rows(), "user_id"), "mean_of_user_id_means")


EXTREME = ["title", "rating", "release_year", "review_year", "age_at_review"]


def oldest_at_review(run: Run) -> DataFrame:
    latest = profile.first_per_item(features.add_calendar(run.train()), [-F.col("review_year")], KEY)
    rows = features.add_age(features.add_release_year(delimited.fact_join(latest, run.items())))
    return profile.greatest_row(rows, "age_at_review", KEY).select(*EXTREME)


def oldest_release(run: Run) -> DataFrame:
    first = profile.first_per_item(run.train(), [], KEY)
    rows = features.add_release_year(delimited.fact_join(first, run.items()))
    return profile.least_row(rows, "release_year", KEY).select("title", "rating", "release_year")


SKETCHED = ["user_id", "item_id"]


def distinct_by_year(run: Run) -> DataFrame:
    """Distinct users and items per year, and whether the merged sketches of its days are within their error."""
    rows = run.train_rows().withColumn("day", F.floor(F.col("epoch_s") / 86400))
    days = run.ws.save(sketches.summarize(rows, ["day", "review_year"], SKETCHED), "day-sketches").df
    estimated = sketches.distinct_counts(days, ["review_year"], SKETCHED)
    exact = rows.groupBy("review_year").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("item_id").alias("items"))
    near = lambda estimate, count: F.abs(F.col(estimate) - F.col(count)) <= F.col(count) * sketches.ERROR
    return estimated.join(exact, "review_year").select(
        "review_year", "n", "users", "items",
        near("distinct_user_id", "users").alias("users_near"), near("distinct_item_id", "items").alias("items_near"),
    )


def hist_rating(run: Run) -> DataFrame:
    return profile.histogram(run.train_rows(), "rating", 0.5)


def density_grid(run: Run) -> DataFrame:
    means = profile.profile_by(run.train_rows(), "item_id")
    return profile.density_grid(means, "item_id", "mean_rating", 100, 0.25)


def profile_events(run: Run) -> DataFrame:
    return rounded(profile.profile_by(run.events(), "event_type", "value"), "mean_value")


# labels


def label_explode(run: Run) -> DataFrame:
    rows = delimited.fact_join(run.train(), run.items()).select(*KEY, "rating", "genres")
    return labels.explode_labels(rows)


def listed(run: Run) -> DataFrame:
    """Sums and counts of the training ratings per label list."""
    return profile.sums_by_item_attribute(run.train(), run.items(), "genres")


def profile_label(run: Run) -> DataFrame:
    return rounded(labels.profile_label(listed(run)), "mean_rating")


def label_contains_counts(run: Run) -> DataFrame:
    return labels.contains_counts(listed(run), LABEL_WORDS)


def label_indicators(run: Run) -> DataFrame:
    return labels.indicators(run.items(), LABEL_WORDS).select("item_id", *[f"has_{w}" for w in LABEL_WORDS])


# effects


def fit_last(specs: tuple[E.EffectSpec, ...], lambda_: float = 0.0) -> Query:
    """The last effect of ``specs``, fitted after the others."""

    def make(run: Run) -> DataFrame:
        model = E.fit(run.frame(), specs, run.ws, [lambda_])
        return rounded(model.table(specs[-1].name), "b")

    return query(make)


def score_with(specs: tuple[E.EffectSpec, ...], lambda_: float = 0.0) -> Query:
    def make(run: Run) -> DataFrame:
        frame = run.frame()
        model = E.fit(frame, specs, run.ws, [lambda_])
        scored = scoring.score(frame.filter("is_val"), model)
        found = [f"b_{s.name}" for s in specs]
        return rounded(scored.select(*KEY, "rating", *found, "pred"), *found, "pred")

    return query(make)


def rmse_with(specs: tuple[E.EffectSpec, ...], lambda_: float = 0.0) -> Query:
    def make(run: Run) -> DataFrame:
        frame = run.frame()
        model = E.fit(frame, specs, run.ws, [lambda_])
        return rounded(scoring.rmse(scoring.score(frame.filter("is_val"), model)), "rmse")

    return query(make)


def score_ladder(run: Run) -> DataFrame:
    frame = run.frame()
    model = E.fit(frame, E.PLAIN_ORDER, run.ws)
    steps = [f"pred_{k}" for k in range(len(E.PLAIN_ORDER) + 1)]
    return rounded(scoring.ladder(frame.filter("is_val"), model).select(*KEY, "rating", *steps), *steps)


def ladder_of(specs: tuple[E.EffectSpec, ...], lambda_: float = 0.0) -> Query:
    def make(run: Run) -> DataFrame:
        frame = run.frame()
        model = E.fit(frame, specs, run.ws, [lambda_])
        return rounded(scoring.ladder_rmse(frame.filter("is_val"), model), "rmse")

    return query(make)


def fit_shrunk_all(run: Run) -> DataFrame:
    return rounded(E.fit(run.frame(), E.SHRUNK_ORDER, run.ws, [LAMBDA]).long(), "b")


BEFORE_RETURN = (E.ITEM, E.USER)


def score_cold_keys(run: Run) -> DataFrame:
    """Held-out rows scored before any of them is returned to training."""
    frame = run.ws.save(run.flagged(), "frame").df
    model = E.fit(frame, BEFORE_RETURN, run.ws, [LAMBDA], held="temp")
    scored = scoring.score_with_unseen(frame.filter("temp"), model)
    out = scored.select(*KEY, "b_item", "b_user", "pred", "unseen_item", "unseen_user")
    return rounded(out, "b_item", "b_user", "pred")


def unseen_counts(run: Run) -> DataFrame:
    """Held-out rows per effect whose key has no training row, before any of them is returned."""
    frame = run.ws.save(features.add_all(delimited.fact_join(run.flagged(), run.items())), "frame").df
    model = E.fit(frame, E.SHRUNK_ORDER, run.ws, [LAMBDA], held="temp")
    return scoring.unseen_counts(frame.filter("temp"), model)


def effect_means(run: Run) -> DataFrame:
    frame = run.frame()
    model = E.fit(frame, E.SHRUNK_ORDER, run.ws, [LAMBDA])
    return rounded(scoring.effect_means(scoring.score(frame.filter("is_val"), model), model), "mean_b")


def model_roundtrip(run: Run) -> DataFrame:
    frame = run.frame()
    fitted = E.fit(frame, E.SHRUNK_ORDER, run.ws, [LAMBDA])
    path = model_store.save_model(fitted, run.ws.path("model"))
    model = model_store.load_model(run.spark, path, run.ws)
    return rounded(scoring.score(frame.filter("is_val"), model).select(*KEY, "pred"), "pred")


PARTS = 8  # at least; a larger log gets more, so that a part stays small


def rmse_parts(run: Run) -> DataFrame:
    """Item and user effects fitted and scored on a log in parts, without broadcasts of effects."""
    ws = run.ws.limited(0)
    keys = [s.key for s in (E.USER, E.ITEM)]
    stored = run.stored_frame()
    with parts.deal(stored.df, ws, keys, parts.enough(stored.rows, PARTS)) as dealt:
        model = E.fit(dealt.frame, E.SHRUNK_ORDER, ws, [LAMBDA], parts=dealt)
        found = ws.save(scoring.rmse(scoring.score(dealt.frame.filter("is_val"), model)), "rmse").df
    return rounded(found, "rmse")


# effects of single labels


def label_model(run: Run, tastes: bool = False) -> label_effects.LabelModel:
    frame = run.frame()
    base = E.fit(frame, E.SHRUNK_ORDER, run.ws, [LAMBDA])
    model = label_effects.fit_labels(frame, base, run.ws, LAMBDA)
    return label_effects.fit_user_labels(frame, model, run.ws, LAMBDA) if tastes else model


def fit_labels(run: Run) -> DataFrame:
    return rounded(label_model(run).effects.df, "b")


def fit_user_label(run: Run) -> DataFrame:
    return rounded(label_model(run, tastes=True).tastes.df.select("user_id", "label", "b", "n"), "b")


def rmse_labels(run: Run) -> DataFrame:
    scored = label_effects.score_labels(run.frame().filter("is_val"), label_model(run), run.ws)
    return rounded(scoring.rmse(scored), "rmse")


def rmse_user_label(run: Run) -> DataFrame:
    scored = label_effects.score_labels(run.frame().filter("is_val"), label_model(run, tastes=True), run.ws)
    return rounded(scoring.rmse(scored), "rmse")


# trees

FOREST_FEATURES = ("b_item", "b_user", "release_year", "age_at_review", "review_year", "review_month", "review_wday", "review_hour")
FEATURES_EACH = 5


def forest_rows(run: Run) -> DataFrame:
    """The frame with the effects of item and user as two more numbers."""
    frame = run.frame()
    scored = scoring.score(frame, E.fit(frame, (E.ITEM, E.USER), run.ws, [LAMBDA]))
    shown = scored.withColumns({c: F.round(c, 9) for c in ("b_item", "b_user")})
    return run.ws.save(shown.select(*KEY, "rating", "is_val", *FOREST_FEATURES), "forest-rows").df


def fit_tree(run: Run) -> DataFrame:
    """One tree of depth 2 on all rows and features."""
    tree = forest.fit_forest(forest_rows(run), FOREST_FEATURES, KEY, run.ws, trees=1, depth=2, row_share=1000)
    cuts = tree.table(run.ws).withColumn("cut", F.col("cut").cast("double"))
    return rounded(cuts, "cut", "mean_left", "mean_right")


def rmse_forest(run: Run) -> DataFrame:
    rows = forest_rows(run)
    model = forest.fit_forest(rows, FOREST_FEATURES, KEY, run.ws, features_each=FEATURES_EACH)
    return rounded(scoring.rmse(model.predict(rows.filter("is_val"))), "rmse")


# tuning


def cv_input(run: Run) -> DataFrame:
    train = run.frame("h").filter(~F.col("is_val"))
    return tuning.cv_frame(train)  # two columns that follow from the stored hash: not worth a copy of the rows


def lambda_grid(run: Run) -> DataFrame:
    """The grid, and the validation error of each of its lambdas."""
    frame = run.frame()
    model = E.fit(frame, E.SHRUNK_ORDER, run.ws, tuning.grid_values())
    return rounded(tuning.grid_rmse(frame.filter("is_val"), model), "rmse")


def grid(run: Run) -> DataFrame:
    return tuning.cv_rmse_grid(cv_input(run), E.SHRUNK_ORDER, run.ws)


def cv_rmse_grid(run: Run) -> DataFrame:
    return rounded(grid(run), "rmse")


def cv_rmse_kfold(run: Run) -> DataFrame:
    stored = run.stored_frame("h")
    at_once = stored.rows <= KFOLD_ROWS
    train = stored.df.filter(~F.col("is_val"))
    return rounded(tuning.kfold_rmse_grid(train, E.SHRUNK_ORDER, run.ws, KFOLD_GRID, at_once=at_once), "rmse")


def cv_rmse_stratified(run: Run) -> DataFrame:
    train = run.frame("h").filter(~F.col("is_val"))
    rows = tuning.stratified_cv_frame(train, run.ws, KEY)
    stored = run.ws.save(rows, "cv-stratified", partition_by=["is_test"]).df
    return rounded(tuning.cv_rmse_grid(stored, E.SHRUNK_ORDER, run.ws, KFOLD_GRID), "rmse")


def cv_best_lambda(run: Run) -> DataFrame:
    return rounded(tuning.best_lambda(grid(run)), "rmse")


def final_lambda(run: Run) -> DataFrame:
    return rounded(tuning.final_lambda(tuning.best_lambda(grid(run))), "final_lambda")


def rmse_final(run: Run) -> DataFrame:
    """Refit on all training rows with the tuned lambda, and score validation."""
    frame = run.frame("h")
    best = tuning.best_lambda(grid(run))
    chosen = tuning.final_lambda(best).first()["final_lambda"]
    model = E.fit(frame, E.SHRUNK_ORDER, run.ws, [chosen])
    out = scoring.rmse(scoring.score(frame.filter("is_val"), model))
    return rounded(out.select(F.lit(chosen).alias("final_lambda"), "rmse"), "final_lambda", "rmse")


# streaming


def stream_scores(run: Run) -> DataFrame:
    stored = run.stored_frame()
    model = E.fit(stored.df, E.SHRUNK_ORDER, run.ws, [LAMBDA])
    arriving = run.spark.readStream.schema(stored.df.schema).parquet(stored.path).filter("is_val")
    scored = live.score_stream(arriving, model).select(*KEY, "pred")
    return rounded(live.run_to_table(scored, run.ws, "scores"), "pred")


LEARNED = (E.ITEM, E.USER, E.RELEASE_YEAR, E.REVIEW_YEAR, E.REVIEW_WDAY)
FILES_A_BATCH = 3


def learned(run: Run) -> E.EffectModel:
    """A model of the training rows, learned batch by batch as they arrive."""
    stored = run.stored_frame()
    state = learning.LearningState(run.ws, run.ws.path("state"), LEARNED)
    if run.ws.exists(f"{stored.path}/is_val=false"):
        # files of held-out rows would take up room in the batches: a pattern leaves them out
        arriving = run.spark.readStream.schema(stored.df.schema).option("maxFilesPerTrigger", FILES_A_BATCH)
        rows = arriving.option("basePath", stored.path).parquet(f"{stored.path}/is_val=fals[e]").filter(~F.col("is_val"))
        learning.learn_stream(rows, state, run.ws.path("state-progress")).awaitTermination()
    return state.model(LAMBDA)


def stream_learn(run: Run) -> DataFrame:
    return rounded(learned(run).long(), "b")


def rmse_stream_learn(run: Run) -> DataFrame:
    scored = scoring.score(run.frame().filter("is_val"), learned(run))
    return rounded(scoring.rmse(scored), "rmse")


def stream_event_profile(run: Run) -> DataFrame:
    # the table may be one file or a folder of files: a stream takes either from a pattern only
    arriving = run.spark.readStream.schema(run.events().schema).parquet(f"{run.dir}/events.parque[t]")
    events = arriving.withColumn("ts", F.col("ts").cast("timestamp"))
    rolling = live.rolling_profile(events, "ts", "value", ["event_type"], "1 day", "1 hour")
    out = live.run_to_table(rolling, run.ws, "event-profile", ["window_start", "window_end", "event_type"])
    ends = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")]
    return rounded(out.select(*ends, "event_type", "mean_value", "n"), "mean_value")


LATE_EVENTS = "event_id % 10 = 0"  # these arrive when all others have been seen
ALLOWED_S = 3600


def stream_late_windows(run: Run) -> DataFrame:
    """Daily windows of events of which a tenth arrives late, after a restart of the stream."""
    events = run.events().withColumn("ts", F.col("ts").cast("timestamp"))
    folder, progress = run.ws.path("arriving"), run.ws.path("late-progress")
    state = run.ws.path("late-windows")
    for late in (False, True):
        part = events.filter(LATE_EVENTS) if late else events.filter(f"NOT {LATE_EVENTS}")
        part.write.mode("append").parquet(folder)
        windows = lateness.LateWindows(run.ws, state, events.schema, "ts", "value", ["event_type"], "1 day", ALLOWED_S)
        arriving = run.spark.readStream.schema(events.schema).parquet(folder)
        lateness.window_stream(arriving, windows, progress).awaitTermination()
    on = ["window_start", "event_type"]
    late_rows = windows.late().groupBy(*on).agg(F.count(F.lit(1)).alias("n_late"), F.max("seconds_behind").alias("most_behind"))
    seen = windows.closed().unionByName(windows.open()).select(*on, "mean_value", "n")
    both = seen.join(late_rows, on, "full").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "mean_value",
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_late", F.lit(0)).alias("n_late"), "most_behind",
    )
    return rounded(both, "mean_value", "most_behind")


def _up_to(order: tuple[E.EffectSpec, ...], last: E.EffectSpec) -> tuple[E.EffectSpec, ...]:
    return order[: order.index(last) + 1]


def queries() -> dict[str, Query]:
    plain = {s.name: _up_to(E.PLAIN_ORDER, s) for s in E.PLAIN_ORDER}
    shrunk = {s.name: _up_to(E.SHRUNK_ORDER, s) for s in E.SHRUNK_ORDER}
    out: dict[str, Query] = {}

    def add(*makes: Callable[[Run], DataFrame]) -> None:
        out.update({m.__name__: query(m) for m in makes})

    add(src_ratings, src_items, fact_join)
    add(feat_reviewed_at, feat_calendar, feat_release_year, feat_release_year_regex, feat_age)
    add(feat_all)
    add(preview_features, filter_unparsed_year)
    out["split_hash"] = query(lambda run: run.flagged().select(*KEY, "h", "temp"))
    add(split_exact, split_exact_fraction, split_hash_fraction, split_quantile, split_folds, split_folds_exact)
    add(split_inner_exact, split_semi_item, split_validation)
    add(split_returned, split_returned_joins, split_training, split_protected)
    add(profile_summary, count_by_genres, count_by_rating, top_titles)
    out["profile_item"], out["profile_user"] = profile_of("item_id"), profile_of("user_id")
    for part in features.CALENDAR:
        out[f"profile_{part}"] = profile_of(part)
    add(profile_release_year, profile_age, profile_genres, mean_of_user_means)
    add(distinct_by_year, oldest_at_review, oldest_release, hist_rating, density_grid, profile_events)
    add(label_explode, profile_label, label_contains_counts, label_indicators)
    for name, specs in plain.items():
        out[f"fit_{name}"] = fit_last(specs)
    out["fit_user_only"] = fit_last((E.USER,))
    out["score_item"], out["score_user_only"] = score_with((E.ITEM,)), score_with((E.USER,))
    add(score_ladder)
    out["rmse_naive"], out["rmse_item"] = rmse_with(()), rmse_with((E.ITEM,))
    out["rmse_user_only"], out["rmse_item_user"] = rmse_with((E.USER,)), rmse_with((E.ITEM, E.USER))
    out["rmse_ladder"] = ladder_of(E.PLAIN_ORDER)
    add(fit_shrunk_all)
    for name, specs in shrunk.items():
        out[f"fit_shrunk_{name}"] = fit_last(specs, LAMBDA)
    out["score_shrunk"] = score_with(E.SHRUNK_ORDER, LAMBDA)
    add(score_cold_keys, unseen_counts, effect_means)
    out["rmse_shrunk"] = rmse_with(E.SHRUNK_ORDER, LAMBDA)
    out["rmse_shrunk_ladder"] = ladder_of(E.SHRUNK_ORDER, LAMBDA)
    add(model_roundtrip, rmse_parts)
    add(fit_labels, rmse_labels, fit_user_label, rmse_user_label)
    add(fit_tree, rmse_forest)
    add(lambda_grid, cv_rmse_grid, cv_rmse_kfold, cv_rmse_stratified, cv_best_lambda, final_lambda, rmse_final)
    add(stream_scores, stream_learn, rmse_stream_learn, stream_event_profile, stream_late_windows)
    return out
