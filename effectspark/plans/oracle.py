"""The same results in DuckDB SQL, written independently of the Spark plans.

Effects are computed here by window sums over all rows, step after step.
"""

from __future__ import annotations

STANDIN = """
ratings_raw AS (
  SELECT o.o_custkey AS user_id, l.l_partkey AS item_id,
         least(5e0, greatest(5e-1, floor(2e0*(3e0
           + ((l.l_partkey*37) % 11 - 5)/8e0
           + ((o.o_custkey*53) % 7 - 3)/8e0
           + (ceil(l.l_quantity/5e0)/2e0 - 2.75e0)/2e0) + 5e-1)/2e0)) AS rating,
         epoch(l.l_shipdate)::BIGINT + (l.l_orderkey*7919 + l.l_linenumber*104729) % 86400 AS epoch_s
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
items_raw AS (
  SELECT p_partkey AS item_id,
         CASE WHEN p_partkey % 97 = 0 THEN p_name
              ELSE p_name || ' (' || CAST(1930 + p_partkey % 70 AS varchar) || ')' END AS title,
         p_type || '|' || replace(p_name, ' ', '|') AS genres
  FROM part),
fx_features AS (
  SELECT *, review_year - release_year AS age_at_review FROM (
    SELECT r.*, m.title, m.genres,
           year(make_timestamp(epoch_s*1000000))::INT AS review_year,
           month(make_timestamp(epoch_s*1000000))::INT AS review_month,
           (dayofweek(make_timestamp(epoch_s*1000000))+1)::INT AS review_wday,
           day(make_timestamp(epoch_s*1000000))::INT AS review_mday,
           hour(make_timestamp(epoch_s*1000000))::INT AS review_hour,
           try_cast(left(right(title,5), greatest(length(right(title,5))-1, 0)) AS INT) AS release_year
    FROM ratings_raw r LEFT JOIN items_raw m ON r.item_id = m.item_id)),
fx_split AS (
  SELECT *, temp AND bool_or(NOT temp) OVER (PARTITION BY item_id)
                 AND bool_or(NOT temp) OVER (PARTITION BY user_id) AS is_val
  FROM (SELECT *, h % 1000 < 100 OR item_id % 97 = 3 OR user_id % 89 = 5 AS temp
        FROM (SELECT *, ('0x'||substr(md5(concat_ws('|', user_id, item_id, epoch_s)),1,8))::BIGINT AS h
              FROM fx_features))),
train AS (SELECT * FROM fx_split WHERE NOT is_val)
"""

KEY = "user_id, item_id, epoch_s"
CALENDAR = "review_year, review_month, review_wday, review_mday, review_hour"
LAMBDA = 5.0

# (effect, key column) in the two orders
PLAIN = [
    ("item", "item_id"), ("user", "user_id"), ("release_year", "release_year"), ("review_year", "review_year"),
    ("review_month", "review_month"), ("review_mday", "review_mday"), ("review_wday", "review_wday"),
    ("age", "age_at_review"), ("genres", "genres"), ("review_hour", "review_hour"),
]
SHRUNK = [
    ("item", "item_id"), ("user", "user_id"), ("release_year", "release_year"), ("age", "age_at_review"),
    ("genres", "genres"), ("review_wday", "review_wday"), ("review_month", "review_month"),
    ("review_hour", "review_hour"), ("review_year", "review_year"), ("review_mday", "review_mday"),
]


def r6(x: str) -> str:
    """Six places, and no negative zero."""
    return f"CASE WHEN round({x}, 6) = 0 THEN 0e0 ELSE round({x}, 6) END"


def sql(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([STANDIN.strip(), *ctes]) + "\n" + select


def steps(
    order: list[tuple[str, str]], lam: str, source: str = "fx_split", held: str = "is_val", by: str = ""
) -> list[str]:
    """CTEs s0, s1, ...: residual r0 after the mean, r1 after the first effect, and so on."""
    part = f"{by}, " if by else ""
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    out = [f"s0 AS (SELECT *, rating - avg(rating) FILTER (WHERE NOT {held}) {over} AS r0 FROM {source})"]
    for k, (name, key) in enumerate(order, 1):
        r = f"r{k-1}"
        out.append(
            f"s{k} AS (SELECT * EXCLUDE (b), {r} - b AS r{k}, b AS b_{name} FROM (SELECT *, "
            f"coalesce(sum({r}) FILTER (WHERE NOT {held}) OVER g"
            f" / (count(*) FILTER (WHERE NOT {held}) OVER g + {lam}), 0e0) AS b"
            f" FROM s{k-1} WINDOW g AS (PARTITION BY {part}{key})))"
        )
    return out


def mean_sql(held: str = "is_val", source: str = "fx_split") -> str:
    return f"(SELECT avg(rating) FROM {source} WHERE NOT {held})"


def fit_sql(order: list[tuple[str, str]], name: str, lam: float) -> str:
    k = [n for n, _ in order].index(name)
    key = order[k][1]
    b = r6(f"sum(r{k}) / (count(*) + {lam})")
    return sql(
        f"SELECT {key}, {b} AS b, count(*) AS n FROM s{k} WHERE NOT is_val GROUP BY {key}",
        *steps(order[:k], str(lam)),
    )


def fit_all_sql(order: list[tuple[str, str]], lam: float) -> str:
    parts = [
        f"SELECT '{name}' AS effect, CAST({key} AS varchar) AS key, "
        f"{r6(f'sum(r{k}) / (count(*) + {lam})')} AS b, count(*) AS n FROM s{k} WHERE NOT is_val GROUP BY {key}"
        for k, (name, key) in enumerate(order)
    ]
    return sql(" UNION ALL ".join(parts), *steps(order[:-1], str(lam)))


def score_sql(order: list[tuple[str, str]], lam: float, effects: bool = True, rating: bool = True) -> str:
    k = len(order)
    cols = [r6(f"b_{name}") + f" AS b_{name}" for name, _ in order] if effects else []
    shown = ", ".join([KEY, *(["rating"] if rating else []), *cols, r6(f"rating - r{k}") + " AS pred"])
    return sql(f"SELECT {shown} FROM s{k} WHERE is_val", *steps(order, str(lam)))


def rmse_sql(order: list[tuple[str, str]], lam: float) -> str:
    k = len(order)
    return sql(f"SELECT {r6(f'sqrt(avg(r{k}*r{k}))')} AS rmse FROM s{k} WHERE is_val", *steps(order, str(lam)))


def ladder_sql(order: list[tuple[str, str]], lam: float) -> str:
    names = ["mean", *[n for n, _ in order]]
    parts = [
        f"SELECT {k}::INT AS step, '{name}' AS effect, {r6(f'sqrt(avg(r{k}*r{k}))')} AS rmse "
        f"FROM s{len(order)} WHERE is_val"
        for k, name in enumerate(names)
    ]
    return sql(" UNION ALL ".join(parts), *steps(order, str(lam)))


def profile_sql(key: str) -> str:
    return sql(f"SELECT {key}, {r6('avg(rating)')} AS mean_rating, count(*) AS n FROM train GROUP BY {key}")


FOLDED = (
    "cv AS (SELECT *, ((h // 1000) % 10)::INT AS fold, (h // 10000) % 10 = 0 AS is_test FROM train)"
)
KFOLDED = (
    "cv AS (SELECT * EXCLUDE (own), own = fold AS is_test FROM "
    "(SELECT *, ((h // 1000) % 10)::INT AS own FROM train), "
    "(SELECT unnest(range(10))::INT AS fold))"
)
STRATIFIED = (
    "cv AS (SELECT *, row_number() OVER (PARTITION BY rating, fold ORDER BY h, user_id, item_id, epoch_s) <= "
    "(count(*) OVER (PARTITION BY rating, fold) + 9) // 10 AS is_test FROM (SELECT *, "
    "((row_number() OVER (PARTITION BY rating ORDER BY h, user_id, item_id, epoch_s) - 1) % 10)::INT AS fold FROM train))"
)
GRID = "(SELECT 1e0 + unnest(range(37)) * 25e-2 AS lam)"
KFOLD_GRID = "(SELECT unnest([1e0, 5e0, 10e0]) AS lam)"


def grid_ctes(folded: str = FOLDED, grid: str = GRID) -> list[str]:
    """Every row once per lambda, and the error per fold and lambda."""
    narrow = f"rating, fold, is_test, {', '.join(key for _, key in SHRUNK)}"
    rows = f"sweep AS (SELECT {narrow}, lam FROM cv, {grid})"
    chain = steps(SHRUNK, "lam", "sweep", "is_test", "fold, lam")
    errors = "errors AS (SELECT fold, lam, sqrt(avg(r10*r10)) AS rmse FROM s10 WHERE is_test GROUP BY 1, 2)"
    best = (
        "best AS (SELECT fold, lam, rmse FROM (SELECT *, row_number() OVER "
        "(PARTITION BY fold ORDER BY round(rmse, 9), lam) AS k FROM errors) WHERE k = 1)"
    )
    return [folded, rows, *chain, errors, best]


def rmse_final_sql() -> str:
    chosen = "chosen AS (SELECT avg(lam) AS final_lambda FROM best)"
    refit = [
        c.replace("s0 AS", "f0 AS") if k == 0 else c.replace(f"s{k} AS", f"f{k} AS").replace(f"FROM s{k-1}", f"FROM f{k-1}")
        for k, c in enumerate(steps(SHRUNK, "(SELECT final_lambda FROM chosen)"))
    ]
    return sql(
        f"SELECT (SELECT {r6('final_lambda')} FROM chosen) AS final_lambda, "
        f"{r6('sqrt(avg(r10*r10))')} AS rmse FROM f10 WHERE is_val",
        *grid_ctes(), chosen, *refit,
    )


def lambda_grid_sql() -> str:
    narrow = f"rating, is_val, {', '.join(key for _, key in SHRUNK)}"
    return sql(
        f"SELECT lam AS \"lambda\", {r6('sqrt(avg(r10*r10))')} AS rmse FROM s10 WHERE is_val GROUP BY lam",
        f"sweep AS (SELECT {narrow}, lam FROM fx_split, {GRID})",
        *steps(SHRUNK, "lam", "sweep", "is_val", "lam"),
    )


FOREST_FEATURES = ("b_item", "b_user", "release_year", "age_at_review", "review_year", "review_month", "review_wday", "review_hour")
# five features for each of four trees: the least by md5 of tree|feature
FOREST_CHOICE = (
    "SELECT t, f FROM (SELECT t, f, row_number() OVER (PARTITION BY t ORDER BY md5(t || '|' || f)) AS k "
    "FROM (SELECT unnest(range(4))::INT AS t), (SELECT unnest(range(8))::INT AS f)) WHERE k <= 5"
)


def forest_ctes(choice: str, depth: int, share: int) -> list[str]:
    """Rows with the node they reach in each tree (``n0`` ... ), and the best cut per node (``best0`` ...)."""
    made = [f"round({c}, 9) AS {c}" if c.startswith("b_") else c for c in FOREST_FEATURES]
    levels = ", ".join(f"{i}e0 / 16" for i in range(1, 16))
    cuts = [f"list_distinct(quantile_disc({c}, [{levels}])) AS q{k}" for k, c in enumerate(FOREST_FEATURES)]
    bins = [
        f"CASE WHEN {c} IS NULL THEN -1 ELSE len(list_filter(q{k}, lambda v: {c} > v))::INT END AS x{k}"
        for k, c in enumerate(FOREST_FEATURES)
    ]
    bin_of = "CASE {} " + " ".join(f"WHEN {k} THEN x{k}" for k in range(len(FOREST_FEATURES))) + " END"
    used = "TRUE" if share >= 1000 else (
        f"('0x' || substr(md5(concat_ws('|', t, user_id, item_id, epoch_s)), 1, 8))::BIGINT % 1000 < {share}"
    )
    out = [
        *steps(SHRUNK[:2], str(LAMBDA)),
        f"f AS (SELECT {KEY}, rating, is_val, {', '.join(made)} FROM s2)",
        f"cuts AS (SELECT {', '.join(cuts)} FROM f WHERE NOT is_val)",
        f"binned AS (SELECT {KEY}, rating, is_val, {', '.join(bins)} FROM f, cuts)",
        f"choice AS ({choice})",
        f"n0 AS (SELECT *, {used} AND NOT is_val AS learns, 1 AS node FROM binned, (SELECT DISTINCT t FROM choice))",
    ]
    for d in range(depth):
        out += [
            f"h{d} AS (SELECT t, node, f, {bin_of.format('f')} AS bin, count(*) AS n, sum(rating) AS s "
            f"FROM n{d} JOIN choice USING (t) WHERE learns GROUP BY ALL)",
            f"c{d} AS (SELECT t, node, f, bin, sum(n) OVER u AS nl, sum(s) OVER u AS sl, sum(n) OVER w AS n, sum(s) OVER w AS s "
            f"FROM h{d} WINDOW w AS (PARTITION BY t, node, f), u AS (PARTITION BY t, node, f ORDER BY bin))",
            f"best{d} AS (SELECT t, node, min(struct_pack(loss := -gain, f := f, bin := bin, n := n, nl := nl, s := s, sl := sl)) AS b FROM ("
            f"SELECT *, round(sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n, 6) AS gain FROM c{d} WHERE nl >= 20 AND n - nl >= 20) "
            "WHERE gain > 0 GROUP BY t, node)",
            f"n{d+1} AS (SELECT n{d}.* EXCLUDE (node), CASE WHEN b IS NULL THEN n{d}.node ELSE 2 * n{d}.node + ({bin_of.format('b.f')} > b.bin)::INT END AS node "
            f"FROM n{d} LEFT JOIN best{d} ON best{d}.t = n{d}.t AND best{d}.node = n{d}.node)",
        ]
    return out


# conjugate gradients over lists: ``rights`` has the residual sum and ``grid`` the counts of pairs, by label
LABEL_STEPS = 60


def label_ctes() -> list[str]:
    names = "(SELECT list(label ORDER BY label) AS names FROM own)"
    return [
        *steps(SHRUNK, str(LAMBDA)),
        "rest AS (SELECT *, list_distinct(string_split(genres, '|')) AS held FROM s10)",
        "single AS (SELECT unnest(held) AS label, held, r10 FROM rest WHERE NOT is_val AND genres IS NOT NULL)",
        "own AS (SELECT label, sum(r10) AS s, count(*) AS n FROM single GROUP BY label)",
        "together AS (SELECT label, other, count(*) AS g FROM (SELECT label, unnest(held) AS other FROM single) GROUP BY ALL)",
        "lines AS (SELECT a.label, list(coalesce(g, 0) + CASE WHEN a.label = b.label THEN 5e0 ELSE 0e0 END ORDER BY b.label) AS line"
        " FROM own a CROSS JOIN own b LEFT JOIN together t ON t.label = a.label AND t.other = b.label GROUP BY a.label)",
        "matrix AS (SELECT list(line ORDER BY label) AS m FROM lines)",
        "walk AS (WITH RECURSIVE w AS ("
        "SELECT 0 AS k, list_transform(list(s ORDER BY label), lambda v: 0e0) AS x, list(s ORDER BY label) AS r, list(s ORDER BY label) AS p FROM own"
        " UNION ALL SELECT k + 1, x, r, list_transform(list_zip(r, p), lambda z: z[1] + z[2] * list_dot_product(r, r) / greatest(rr, 1e-300)) FROM ("
        "SELECT k, rr, list_transform(list_zip(x, p), lambda z: z[1] + a * z[2]) AS x, list_transform(list_zip(r, q), lambda z: z[1] - a * z[2]) AS r, p FROM ("
        "SELECT *, list_dot_product(r, r) AS rr, list_dot_product(r, r) / greatest(list_dot_product(p, q), 1e-300) AS a FROM ("
        "SELECT w.*, list_transform(m, lambda line: list_dot_product(line, p)) AS q FROM w, matrix WHERE k < "
        f"{LABEL_STEPS} AND list_dot_product(r, r) > 1e-22)))) SELECT x FROM w ORDER BY k DESC LIMIT 1)",
        f"effects AS (SELECT label, x[list_position(names, label)] AS c, n FROM own, walk, {names})",
        "row_effects AS (SELECT user_id, item_id, epoch_s, sum(coalesce(c, 0e0)) AS c FROM "
        "(SELECT user_id, item_id, epoch_s, unnest(held) AS label FROM rest WHERE genres IS NOT NULL) LEFT JOIN effects USING (label) GROUP BY ALL)",
        f"after AS (SELECT rest.*, r10 - coalesce(c, 0e0) AS r11 FROM rest LEFT JOIN row_effects USING ({KEY}))",
        "tastes AS (SELECT user_id, label, sum(r11) / (count(*) + 5e0) AS dev, count(*) AS n FROM "
        "(SELECT user_id, unnest(held) AS label, r11 FROM after WHERE NOT is_val AND genres IS NOT NULL) GROUP BY ALL)",
        f"row_tastes AS (SELECT {KEY}, avg(coalesce(dev, 0e0)) AS dev FROM "
        f"(SELECT {KEY}, unnest(held) AS label FROM after WHERE is_val AND genres IS NOT NULL) LEFT JOIN tastes USING (user_id, label) GROUP BY ALL)",
    ]


def queries() -> dict[str, str]:
    out: dict[str, str] = {}
    out["src_ratings"] = sql(f"SELECT {KEY}, rating FROM ratings_raw")
    out["src_items"] = sql("SELECT item_id, title, genres FROM items_raw")
    out["fact_join"] = sql(f"SELECT {KEY}, rating, title, genres FROM fx_features")

    out["feat_reviewed_at"] = sql(f"SELECT {KEY}, make_timestamp(epoch_s*1000000) AS reviewed_at FROM ratings_raw")
    out["feat_calendar"] = sql(f"SELECT {KEY}, {CALENDAR} FROM fx_features")
    out["feat_release_year"] = sql(
        "SELECT item_id, title, try_cast(left(right(title,5), greatest(length(right(title,5))-1, 0)) AS INT)"
        " AS release_year FROM items_raw"
    )
    out["feat_release_year_regex"] = sql(
        r"SELECT item_id, title, try_cast(regexp_extract(title, '\((\d{4})\)\s*$', 1) AS INT) AS release_year"
        " FROM items_raw"
    )
    out["feat_age"] = sql(f"SELECT {KEY}, release_year, review_year, age_at_review FROM fx_features")
    out["feat_all"] = sql("SELECT *, make_timestamp(epoch_s*1000000) AS reviewed_at FROM fx_features")
    out["preview_features"] = sql(
        f"SELECT {KEY}, title, release_year, review_year, age_at_review FROM train ORDER BY {KEY} LIMIT 10"
    )
    out["filter_unparsed_year"] = sql(f"SELECT {KEY}, title FROM train WHERE release_year IS NULL")

    out["split_hash"] = sql(f"SELECT {KEY}, h, temp FROM fx_split")
    out["split_exact"] = sql(
        f"SELECT {KEY}, rating, h FROM (SELECT *, row_number() OVER (PARTITION BY rating ORDER BY h, {KEY}) AS k, "
        "count(*) OVER (PARTITION BY rating) AS n FROM fx_split) WHERE k <= ceil(n * 100 / 1000e0)"
    )
    out["split_exact_fraction"] = sql(
        f"SELECT {KEY}, rating, h FROM (SELECT *, row_number() OVER (PARTITION BY rating ORDER BY h, {KEY}) AS k, "
        "count(*) OVER (PARTITION BY rating) AS n FROM fx_split) WHERE k <= (n * 375 + 9999) // 10000"
    )
    out["split_hash_fraction"] = sql(
        f"SELECT {KEY}, h, (h % 1000) * 4294968 + h // 1000 < 161061300 AS held FROM fx_split"
    )
    cuts = "cuts AS (SELECT quantile_disc(epoch_s, [2e-1, 4e-1, 6e-1, 8e-1]) AS q FROM ratings_raw)"
    out["split_quantile"] = sql(
        f"SELECT {KEY}, stratum, row_number() OVER (PARTITION BY stratum ORDER BY h, {KEY}) <= "
        "(count(*) OVER (PARTITION BY stratum) + 9) // 10 AS held FROM (SELECT s.*, "
        "((epoch_s > q[1])::INT + (epoch_s > q[2])::INT + (epoch_s > q[3])::INT + (epoch_s > q[4])::INT)::INT AS stratum "
        "FROM fx_split s, cuts)",
        cuts,
    )
    out["split_inner_exact"] = sql(f"SELECT {KEY}, fold, is_test FROM cv", STRATIFIED)
    out["split_folds"] = sql(f"SELECT {KEY}, fold, is_test FROM cv", FOLDED)
    out["split_folds_exact"] = sql(
        f"SELECT {KEY}, rating, h, "
        f"((row_number() OVER (PARTITION BY rating ORDER BY h, {KEY}) - 1) % 10)::INT AS fold FROM train"
    )
    out["split_semi_item"] = sql(
        f"SELECT {KEY} FROM fx_split t WHERE temp AND EXISTS "
        "(SELECT 1 FROM fx_split u WHERE NOT u.temp AND u.item_id = t.item_id)"
    )
    out["split_validation"] = sql(f"SELECT {KEY}, rating FROM fx_split WHERE is_val")
    out["split_returned"] = sql(f"SELECT {KEY}, rating FROM fx_split WHERE temp AND NOT is_val")
    out["split_returned_joins"] = out["split_returned"]
    out["split_training"] = sql(f"SELECT {KEY}, rating FROM train")
    out["split_protected"] = sql(f"SELECT {KEY}, temp, is_val FROM fx_split")

    out["profile_summary"] = sql(
        "SELECT count(*) AS row_count, count(DISTINCT item_id) AS items, count(DISTINCT user_id) AS users, "
        f"{r6('avg(rating)')} AS mean_rating, {r6('stddev_samp(rating)')} AS sd_rating FROM train"
    )
    out["count_by_genres"] = sql("SELECT genres, count(*) AS n FROM train GROUP BY genres")
    out["count_by_rating"] = sql("SELECT rating, count(*) AS n FROM train GROUP BY rating ORDER BY n DESC, rating")
    out["top_titles"] = sql(
        "SELECT title, count(*) AS ratings FROM train GROUP BY title ORDER BY ratings DESC, title LIMIT 10"
    )
    for name, key in PLAIN:
        out[f"profile_{name}"] = profile_sql(key)
    out["mean_of_user_means"] = sql(
        f"SELECT {r6('avg(m)')} AS mean_of_user_id_means FROM (SELECT avg(rating) AS m FROM train GROUP BY user_id)"
    )
    out["distinct_by_year"] = sql(
        "SELECT review_year, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, "
        "TRUE AS users_near, TRUE AS items_near FROM train GROUP BY review_year"
    )
    out["oldest_at_review"] = sql(
        "SELECT title, rating, release_year, review_year, age_at_review FROM train "
        f"ORDER BY age_at_review DESC NULLS LAST, {KEY} LIMIT 1"
    )
    out["oldest_release"] = sql(
        f"SELECT title, rating, release_year FROM train WHERE release_year IS NOT NULL "
        f"ORDER BY release_year, {KEY} LIMIT 1"
    )
    out["hist_rating"] = sql(
        "SELECT floor(rating / 5e-1) * 5e-1 AS bin_start, count(*) AS n FROM train GROUP BY 1"
    )
    out["density_grid"] = sql(
        "SELECT floor(item_id / 100e0)::BIGINT AS x_bin, floor(m / 25e-2)::BIGINT AS y_bin, count(*) AS n "
        "FROM (SELECT item_id, avg(rating) AS m FROM train GROUP BY item_id) GROUP BY 1, 2"
    )
    out["profile_events"] = (
        f"SELECT event_type, {r6('avg(value)')} AS mean_value, count(*) AS n FROM events GROUP BY event_type"
    )

    exploded = f"exploded AS (SELECT {KEY}, rating, unnest(string_split(genres, '|')) AS label FROM train)"
    out["label_explode"] = sql("SELECT * FROM exploded", exploded)
    out["profile_label"] = sql(
        f"SELECT label, {r6('avg(rating)')} AS mean_rating, count(*) AS n FROM exploded GROUP BY label", exploded
    )
    words = ("ECONOMY", "SMALL", "ring", "red")
    out["label_contains_counts"] = sql(
        " UNION ALL ".join(
            f"SELECT '{w}' AS word, count(*) FILTER (WHERE contains(genres, '{w}')) AS n FROM train" for w in words
        )
    )
    out["label_indicators"] = sql(
        "SELECT item_id, "
        + ", ".join(f"list_contains(string_split(genres, '|'), '{w}') AS has_{w}" for w in words)
        + " FROM items_raw"
    )

    for name, _ in PLAIN:
        out[f"fit_{name}"] = fit_sql(PLAIN, name, 0.0)
    user = [("user", "user_id")]
    out["fit_user_only"] = fit_sql(user, "user", 0.0)
    out["score_item"], out["score_user_only"] = score_sql(PLAIN[:1], 0.0), score_sql(user, 0.0)
    preds = ", ".join(r6(f"rating - r{k}") + f" AS pred_{k}" for k in range(11))
    out["score_ladder"] = sql(f"SELECT {KEY}, rating, {preds} FROM s10 WHERE is_val", *steps(PLAIN, "0.0"))
    out["rmse_naive"], out["rmse_item"] = rmse_sql([], 0.0), rmse_sql(PLAIN[:1], 0.0)
    out["rmse_user_only"], out["rmse_item_user"] = rmse_sql(user, 0.0), rmse_sql(PLAIN[:2], 0.0)
    out["rmse_ladder"] = ladder_sql(PLAIN, 0.0)

    out["fit_shrunk_all"] = fit_all_sql(SHRUNK, LAMBDA)
    for name, _ in SHRUNK:
        out[f"fit_shrunk_{name}"] = fit_sql(SHRUNK, name, LAMBDA)
    out["score_shrunk"] = score_sql(SHRUNK, LAMBDA)
    seen = "count(*) FILTER (WHERE NOT temp) OVER (PARTITION BY {}) = 0"
    cold = (
        f"cold AS (SELECT *, {seen.format('item_id')} AS unseen_item, {seen.format('user_id')} AS unseen_user FROM s2)"
    )
    chain = steps(SHRUNK[:2], str(LAMBDA), "fx_split", "temp")
    out["score_cold_keys"] = sql(
        f"SELECT {KEY}, {r6('b_item')} AS b_item, {r6('b_user')} AS b_user, {r6('rating - r2')} AS pred, "
        "unseen_item, unseen_user FROM cold WHERE temp",
        *chain, cold,
    )
    unseen = ", ".join(
        f"count(*) FILTER (WHERE NOT temp) OVER (PARTITION BY {key}) = 0 AS unseen_{name}" for name, key in SHRUNK
    )
    out["unseen_counts"] = sql(
        " UNION ALL ".join(
            f"SELECT '{name}' AS effect, count(*) FILTER (WHERE unseen_{name}) AS unseen FROM flags WHERE temp"
            for name, _ in SHRUNK
        ),
        f"flags AS (SELECT temp, {unseen} FROM fx_split)",
    )
    out["effect_means"] = sql(
        " UNION ALL ".join(
            f"SELECT '{n}' AS effect, {r6(f'avg(b_{n})')} AS mean_b FROM s10 WHERE is_val" for n, _ in SHRUNK
        ),
        *steps(SHRUNK, str(LAMBDA)),
    )
    out["rmse_shrunk"] = rmse_sql(SHRUNK, LAMBDA)
    out["rmse_parts"] = out["rmse_shrunk"]
    out["rmse_shrunk_ladder"] = ladder_sql(SHRUNK, LAMBDA)
    out["model_roundtrip"] = score_sql(SHRUNK, LAMBDA, effects=False, rating=False)

    out["fit_labels"] = sql(f"SELECT label, {r6('c')} AS b, n FROM effects", *label_ctes())
    out["rmse_labels"] = sql(f"SELECT {r6('sqrt(avg(r11*r11))')} AS rmse FROM after WHERE is_val", *label_ctes())
    out["fit_user_label"] = sql(
        f"SELECT user_id, label, {r6('c + dev')} AS b, t.n FROM tastes t JOIN effects USING (label)", *label_ctes()
    )
    out["rmse_user_label"] = sql(
        f"SELECT {r6('sqrt(avg(pow(r11 - coalesce(dev, 0e0), 2)))')} AS rmse FROM after LEFT JOIN row_tastes USING ({KEY}) WHERE is_val",
        *label_ctes(),
    )

    names = "[" + ", ".join(f"'{c}'" for c in FOREST_FEATURES) + "]"
    lists = "[" + ", ".join(f"[v::DOUBLE for v in q{k}]" for k in range(len(FOREST_FEATURES))) + "]"
    cut_rows = " UNION ALL ".join(f"SELECT t, node, b FROM best{d}" for d in range(2))
    out["fit_tree"] = sql(
        f"SELECT t AS tree, node::INT AS node, {names}[b.f + 1] AS feature, b.bin AS bin, "
        f"CASE WHEN b.bin >= 0 THEN {r6(f'list_sort({lists}[b.f + 1])[b.bin + 1]')} END AS cut, b.n::BIGINT AS n, b.nl::BIGINT AS n_left, "
        f"{r6('b.sl / b.nl')} AS mean_left, {r6('(b.s - b.sl) / (b.n - b.nl)')} AS mean_right FROM ({cut_rows}), cuts",
        *forest_ctes("SELECT 0 AS t, unnest(range(8))::INT AS f", 2, 1000),
    )
    out["rmse_forest"] = sql(
        f"SELECT {r6('sqrt(avg(pow(rating - pred, 2)))')} AS rmse FROM (SELECT {KEY}, any_value(rating) AS rating, avg(mean) AS pred "
        f"FROM n3 JOIN leaves USING (t, node) WHERE is_val GROUP BY {KEY})",
        *forest_ctes(FOREST_CHOICE, 3, 632),
        "leaves AS (SELECT t, node, avg(rating) AS mean FROM n3 WHERE learns GROUP BY t, node)",
    )

    out["lambda_grid"] = lambda_grid_sql()
    out["cv_rmse_grid"] = sql(f"SELECT fold, lam AS \"lambda\", {r6('rmse')} AS rmse FROM errors", *grid_ctes())
    out["cv_rmse_kfold"] = sql(
        f"SELECT fold, lam AS \"lambda\", {r6('rmse')} AS rmse FROM errors", *grid_ctes(KFOLDED, KFOLD_GRID)
    )
    out["cv_rmse_stratified"] = sql(
        f"SELECT fold, lam AS \"lambda\", {r6('rmse')} AS rmse FROM errors", *grid_ctes(STRATIFIED, KFOLD_GRID)
    )
    out["cv_best_lambda"] = sql(f"SELECT fold, lam AS \"lambda\", {r6('rmse')} AS rmse FROM best", *grid_ctes())
    out["final_lambda"] = sql(f"SELECT {r6('avg(lam)')} AS final_lambda FROM best", *grid_ctes())
    out["rmse_final"] = rmse_final_sql()

    out["stream_scores"] = score_sql(SHRUNK, LAMBDA, effects=False, rating=False)
    learned = [*SHRUNK[:3], ("review_year", "review_year"), ("review_wday", "review_wday")]
    out["stream_learn"] = fit_all_sql(learned, LAMBDA)
    out["rmse_stream_learn"] = rmse_sql(learned, LAMBDA)
    out["stream_event_profile"] = (
        "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, "
        "(date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP AS window_end, event_type, "
        f"{r6('avg(value)')} AS mean_value, count(*) AS n FROM events GROUP BY 1, 2, 3"
    )
    out["stream_late_windows"] = f"""
        WITH e AS (SELECT *, date_trunc('day', ts)::TIMESTAMP AS window_start, event_id % 10 = 0 AS tardy FROM events),
        seen AS (SELECT max(ts) AS newest FROM e WHERE NOT tardy),
        judged AS (SELECT *, tardy AND window_start + INTERVAL 1 DAY <= newest - INTERVAL 1 HOUR AS late FROM e, seen)
        SELECT window_start, event_type, {r6('avg(value) FILTER (NOT late)')} AS mean_value, count(*) FILTER (NOT late) AS n,
               count(*) FILTER (late) AS n_late,
               {r6("max((epoch_us(newest) - epoch_us(ts)) / 1e6) FILTER (late)")} AS most_behind FROM judged GROUP BY 1, 2"""
    return out
