"""Registered queries for training, scoring and evaluation (G, H).

Oracle text for training spells the sequential SGD definition out, unrolled
(one group of materialised CTEs per update) for full batches and as one
recursion over all updates for mini-batches, so Spark's multi-model passes are
checked against an independent, literal reading of the rule at any size.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.activation import ACTIVATIONS, activation, sql_activation
from skein.functions.hashing import r6, sql_h32
from skein.operators import columns as C
from skein.operators import evaluate as H
from skein.operators import logistic as L
from skein.operators import rows as R
from skein.operators import sampling as SM
from skein.operators import scale as D
from skein.plans import fixtures as X
from skein.plans.sqltext import r6 as s6
from skein.plans.sqltext import key as key_sql
from skein.plans.sqltext import with_
from skein.plans.table_queries import emb_split, emb_split_sql, sql_li_split
from skein.sources.runlog import parse_run_logs

QUERIES: dict = {}
ORACLE: dict = {}

FULL = 2**31 - 1       # batch size meaning "all rows in one batch"
LI_D = 6
EMB_D = X.EMB_WIDTH
MINI = 4096


def q(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ------------------------------------------------------------ Spark inputs
def li_model_data(spark, sf, classes: int = 2):
    from skein.session import cut_lineage

    # the chain below runs several small jobs over the same rows: cut the
    # lineage once so the lineitem aggregate is not recomputed by each
    base = cut_lineage(X.li_wide(spark, sf, classes))
    w = R.normalise_labels(R.split_ordered(base))
    return D.scale_minmax(w, fit_on="train")


def emb_model_data(spark, sf):
    return emb_split(spark, sf)


def _train_vec(wide):
    return L.vectors_from_wide(wide.where(F.col("split") == "train"))


def _test_cells(wide):
    t = wide.where(F.col("split") == "test")
    return C.to_long(t), t.select("row_id", "label")


def _weights_out(spark, res, models, epochs=None, with_epoch=False):
    w = L.weights_frame(res, epochs)
    cols = ["model_id"] + (["epoch"] if with_epoch else []) + ["feature_id", r6(F.col("w")).alias("w")]
    return w.select(*cols)


# ------------------------------------------------------------ SQL inputs
def sql_li_model(batch: int, classes: int = 2) -> list[tuple[str, str]]:
    return sql_li_split(classes) + [
        ("li_norm", """SELECT row_id, split, features,
            CASE WHEN (SELECT bool_or(label = -1) FROM li_split WHERE split = 'train')
                 THEN CASE WHEN label = 1 THEN 1 ELSE 0 END ELSE label END AS label FROM li_split"""),
        ("li_cells", """SELECT row_id, split, label, feature_id, value FROM (
            SELECT row_id, split, label, CAST(unnest(generate_series(1, len(features))) AS INTEGER) AS feature_id,
                   unnest(features) AS value FROM li_norm) t"""),
        ("st", "SELECT feature_id, min(value) AS lo, max(value) AS hi FROM li_cells WHERE split = 'train' GROUP BY feature_id"),
        ("lx", """SELECT c.row_id, c.split, c.label, c.feature_id,
            (c.value - s.lo) / CASE WHEN s.hi - s.lo = 0 THEN 1.0 ELSE s.hi - s.lo END AS value
            FROM li_cells c JOIN st s ON c.feature_id = s.feature_id"""),
        ("tx", "SELECT row_id, feature_id, value FROM lx WHERE split = 'train' AND value <> 0"),
        ("tr", f"""SELECT row_id, label, batch_id, count(*) OVER (PARTITION BY batch_id) AS bsz FROM (
            SELECT row_id, label, CAST(floor((row_number() OVER (ORDER BY row_id) - 1) / {batch}) AS INTEGER) AS batch_id
            FROM li_norm WHERE split = 'train') t"""),
        ("ntr", "SELECT CAST(count(*) AS DOUBLE) AS n FROM tr"),
        ("vx", "SELECT row_id, feature_id, value FROM lx WHERE split = 'test' AND value <> 0"),
        ("vr", "SELECT row_id, label FROM li_norm WHERE split = 'test'"),
    ]


def sql_emb_model() -> list[tuple[str, str]]:
    return emb_split_sql() + [
        ("tx", "SELECT c.row_id, c.feature_id, c.value FROM emb_cells c JOIN emb_split s ON c.row_id = s.row_id WHERE s.split = 'train'"),
        ("tr", "SELECT row_id, label, 0 AS batch_id, count(*) OVER () AS bsz FROM emb_split WHERE split = 'train'"),
        ("ntr", "SELECT CAST(count(*) AS DOUBLE) AS n FROM tr"),
        ("vx", "SELECT c.row_id, c.feature_id, c.value FROM emb_cells c JOIN emb_split s ON c.row_id = s.row_id WHERE s.split = 'test'"),
        ("vr", "SELECT row_id, label FROM emb_split WHERE split = 'test'"),
    ]


def _mods_sql(models: list[L.Model]) -> str:
    vals = ", ".join(
        f"({m.model_id}, {m.alpha!r}, {m.lambda_para!r}, {m.c!r}, {'NULL' if m.pos_label is None else m.pos_label})"
        for m in models)
    return (f"SELECT CAST(a AS BIGINT) AS model_id, CAST(b AS DOUBLE) AS alpha, CAST(l AS DOUBLE) AS lam, "
            f"CAST(c AS DOUBLE) AS c, CAST(p AS INTEGER) AS pos_label FROM (VALUES {vals}) v(a, b, l, c, p)")


def _act_case(models: list[L.Model], z: str, mid: str) -> str:
    whens = " ".join(f"WHEN {m.model_id} THEN {sql_activation(z, m.activation)}" for m in models)
    return f"(CASE {mid} {whens} END)"


def _pen_case(models: list[L.Model], w: str, mid: str) -> str:
    def pen(m):
        if m.penalty in ("always", "l2"):
            return w
        if m.penalty == "l1":
            return f"sign({w})"
        return "0.0"
    return f"(CASE {mid} " + " ".join(f"WHEN {m.model_id} THEN {pen(m)}" for m in models) + " END)"


def sql_train(models: list[L.Model], width: int, epochs: int, batches: int, decay: bool = False,
              prefix: str = "", tr: str = "tr"):
    """CTEs w0 .. wS plus per-step loss ls<s>; returns (ctes, steps) where
    steps = [(epoch, batch, s)]. ``prefix`` namespaces the CTEs so several
    trainings (e.g. one per batch size) can share one statement; ``tr`` names
    the row table carrying batch_id and bsz."""
    P = prefix
    ctes = [(f"{P}mods", _mods_sql(models)),
            (f"{P}w0", f"SELECT m.model_id, CAST(f AS INTEGER) AS feature_id, 0.0::DOUBLE AS w FROM {P}mods m, range(1, {width + 1}) t(f)")]
    steps = []
    s = 0
    decays = 0
    for e in range(1, epochs + 1):
        for b in range(batches):
            s += 1
            if decay and e > 1 and e % 10 == 0:
                decays += 1
            factor = 0.95 ** decays
            steps.append((e, b, s))
            y = "CASE WHEN m.pos_label IS NULL THEN CAST(r.label AS DOUBLE) WHEN r.label = m.pos_label THEN 1.0 ELSE 0.0 END"
            ctes += [
                (f"{P}z{s}", f"""SELECT r.row_id, m.model_id, coalesce(sum(x.value * w.w), 0.0) AS z
                    FROM {tr} r CROSS JOIN {P}mods m LEFT JOIN tx x ON x.row_id = r.row_id
                    LEFT JOIN {P}w{s - 1} w ON w.model_id = m.model_id AND w.feature_id = x.feature_id
                    WHERE r.batch_id = {b} GROUP BY r.row_id, m.model_id"""),
                (f"{P}e{s}", f"""SELECT z.row_id, z.model_id, z.z, {y} AS y, r.bsz,
                    {_act_case(models, 'z.z', 'z.model_id')} - ({y}) AS err
                    FROM {P}z{s} z JOIN {tr} r ON z.row_id = r.row_id JOIN {P}mods m ON z.model_id = m.model_id"""),
                (f"{P}g{s}", f"""SELECT e.model_id, x.feature_id, sum(e.err * x.value) AS g
                    FROM {P}e{s} e JOIN tx x ON x.row_id = e.row_id GROUP BY e.model_id, x.feature_id"""),
                (f"{P}ls{s}", f"""SELECT model_id, {e} AS epoch, {b} AS batch_id,
                    sum((-0.5 * z + y * z - 0.125 * z * z) * (-1.0 / bsz) - ln(0.5)) AS loss, count(*) AS n
                    FROM {P}e{s} GROUP BY model_id"""),
                (f"{P}w{s}", f"""SELECT w.model_id, w.feature_id,
                    CASE WHEN (SELECT count(*) FROM {tr} WHERE batch_id = {b}) = 0 THEN w.w
                    ELSE w.w - m.c * (m.alpha * {factor!r}) * coalesce(g.g, 0.0) / (SELECT count(*) FROM {tr} WHERE batch_id = {b})
                           - m.lam * (m.alpha * {factor!r}) * {_pen_case(models, 'w.w', 'w.model_id')} / (SELECT count(*) FROM {tr} WHERE batch_id = {b})
                    END AS w
                    FROM {P}w{s - 1} w JOIN {P}mods m ON w.model_id = m.model_id
                    LEFT JOIN {P}g{s} g ON g.model_id = w.model_id AND g.feature_id = w.feature_id"""),
            ]
    return ctes, steps


def sql_train_steps(models: list[L.Model], width: int, epochs: int, batch: int, prefix: str = "", shuffle: int | None = None, base: str = "li") -> list[tuple[str, str]]:
    """CTEs ending in ``{prefix}steps(s, model_id, w1..wd, loss)``: state 0 is
    zero weights, state s the weights after the s-th update and the loss of its
    batch under the weights before it. One recursion walks over all batches of
    all epochs, however many there are; ``{prefix}visits(s, epoch, batch_id)``
    lists them."""
    P, d = prefix, range(1, width + 1)
    y = "(CASE WHEN m.pos_label IS NULL THEN CAST(t.label AS DOUBLE) WHEN t.label = m.pos_label THEN 1.0 ELSE 0.0 END)"
    z = "(" + " + ".join(f"r.w{j} * t.x{j}" for j in d) + ")"
    key = f"CASE WHEN e = 1 THEN b ELSE {sql_h32(key_sql(str(shuffle), 'e', 'b'))} END" if shuffle is not None else "b"
    new = ", ".join(f"""any_value(r.w{j}) - any_value(m.c) * any_value(m.alpha) * sum(({_act_case(models, z, 'r.model_id')} - {y}) * t.x{j}) / count(*)
          - any_value(m.lam) * any_value(m.alpha) * {_pen_case(models, f'any_value(r.w{j})', 'r.model_id')} / count(*)""" for j in d)
    return [
        (f"{P}mods", _mods_sql(models)),
        (f"{P}xr", f"""SELECT row_id, label, CAST(floor((row_number() OVER (ORDER BY row_id) - 1) / {batch}) AS BIGINT) AS batch_id,
            {', '.join(f'f[{j}] AS x{j}' for j in d)} FROM (SELECT row_id, any_value(label) AS label, list(value ORDER BY feature_id) AS f
            FROM lx WHERE split = 'train' GROUP BY row_id) t"""),
        (f"{P}visits", f"""SELECT row_number() OVER (ORDER BY e, {key}, b) AS s, e AS epoch, b AS batch_id
            FROM range(1, {epochs + 1}) a(e), (SELECT DISTINCT batch_id AS b FROM {P}xr) q"""),
        (f"{P}steps", f"""SELECT CAST(0 AS BIGINT) AS s, model_id, {', '.join(f'0.0::DOUBLE AS w{j}' for j in d)}, 0.0::DOUBLE AS loss FROM {P}mods
          UNION ALL
          SELECT r.s + 1, r.model_id, {new},
            sum((-0.5 * {z} + {y} * {z} - 0.125 * {z} * {z}) * (-1.0 / v.n) - ln(0.5))
          FROM {P}steps r JOIN (SELECT v.*, c.n FROM {P}visits v JOIN (SELECT batch_id, CAST(count(*) AS DOUBLE) AS n FROM {P}xr GROUP BY batch_id) c USING (batch_id)) v ON v.s = r.s + 1
          JOIN {P}xr t ON t.batch_id = v.batch_id JOIN {P}mods m ON m.model_id = r.model_id
          GROUP BY r.s, r.model_id"""),
        (f"{P}w", " UNION ALL ".join(f"SELECT s, model_id, {j} AS feature_id, w{j} AS w FROM {P}steps" for j in d)),
    ]


def _steps_with(*ctes) -> str:
    return "WITH RECURSIVE " + with_(*ctes, materialize=True)[len("WITH "):].replace("steps AS MATERIALIZED (", "steps AS (")


def _last_w_sql(prefix: str = "") -> str:
    return f"SELECT model_id, CAST(feature_id AS INTEGER) AS feature_id, {s6('w')} AS w FROM {prefix}w WHERE s = (SELECT max(s) FROM {prefix}visits)"


def _final_w_sql(s: int) -> str:
    return f"SELECT model_id, feature_id, {s6('w')} AS w FROM w{s}"


# ------------------------------------------------------------ G1, G2
def _demo_weights(spark, width: int, models: int = 3):
    """Deterministic weights from the model and feature ids."""
    return spark.range(0, models).select(F.col("id").alias("model_id")).select(
        "model_id", F.explode(F.sequence(F.lit(1), F.lit(width))).alias("feature_id")
    ).select("model_id", F.col("feature_id").cast("int"),
             ((((F.col("feature_id") * 7 + F.col("model_id") * 3) % 11) - 5) / F.lit(10.0)).alias("w"))


DEMO_W_SQL = ("dw", f"""SELECT CAST(m AS BIGINT) AS model_id, CAST(f AS INTEGER) AS feature_id,
    ((((f * 7 + m * 3) % 11) - 5) / 10.0)::DOUBLE AS w FROM range(0, 3) a(m), range(1, {EMB_D + 1}) b(f)""")
LS_SQL = ("zs", """SELECT c.row_id, w.model_id, sum(c.value * w.w) AS z FROM emb_cells c JOIN dw w ON c.feature_id = w.feature_id
    GROUP BY c.row_id, w.model_id""")


@q("linear_score", with_(("emb_cells", X.SQL_EMB_CELLS), DEMO_W_SQL, LS_SQL) + f"SELECT row_id, model_id, {s6('z')} AS z FROM zs")
def _linear_score(spark, sf):
    w = X.emb_wide(spark, sf)
    z = L.linear_score(C.to_long(w), _demo_weights(spark, EMB_D), w.select("row_id"))
    return z.select("row_id", "model_id", r6(F.col("z")).alias("z"))


@q("activation", with_(("emb_cells", X.SQL_EMB_CELLS), DEMO_W_SQL, LS_SQL) + " UNION ALL ".join(
    f"SELECT row_id, '{a}' AS act, {s6(sql_activation('z', a))} AS yhat FROM zs WHERE model_id = 0" for a in ACTIVATIONS))
def _activation(spark, sf):
    w = X.emb_wide(spark, sf)
    z = L.linear_score(C.to_long(w), _demo_weights(spark, EMB_D, 1), w.select("row_id"))
    acts = F.explode(F.array(*[F.lit(a) for a in ACTIVATIONS])).alias("act")
    out = z.select("row_id", "z", acts)
    yhat = None
    for a in ACTIVATIONS:
        e = activation(F.col("z"), a)
        yhat = F.when(F.col("act") == a, e) if yhat is None else yhat.when(F.col("act") == a, e)
    return out.select("row_id", "act", r6(yhat).alias("yhat"))


# ------------------------------------------------------------ G4
GRAD_MODELS = [L.Model(0, "linear"), L.Model(1, "cube")]


@q("batch_gradient", with_(*sql_li_model(MINI), ("mods", _mods_sql(GRAD_MODELS))) + f"""
SELECT m.model_id, r.batch_id, x.feature_id, {s6(f"sum((0.5 - CAST(r.label AS DOUBLE)) * x.value) / max(r.bsz)")} AS grad
FROM tr r JOIN tx x ON r.row_id = x.row_id CROSS JOIN mods m GROUP BY m.model_id, r.batch_id, x.feature_id""")
def _batch_gradient(spark, sf):
    vec = _train_vec(li_model_data(spark, sf))
    batched = R.assign_batches(vec, MINI)
    g = L.batch_gradient(batched, LI_D, GRAD_MODELS)
    return g.where(F.col("grad").isNotNull()).select("model_id", "batch_id", "feature_id", r6(F.col("grad")).alias("grad"))


# ------------------------------------------------------------ G5-G11 (training)
def _train_query(name, models, data, epochs, batch, width, out="final", decay=False, shuffle=None, rows_per_chunk=None):
    """Register a Spark training query and its oracle: full-batch training is
    unrolled, mini-batches are one recursion over all of them."""
    base = sql_li_model(batch) if data == "li" else sql_emb_model()
    ctes, steps = sql_train(models, width, epochs, 1, decay)
    last = steps[-1][2]
    if batch != FULL:
        sql = _steps_with(*base, *sql_train_steps(models, width, epochs, batch, shuffle=shuffle)) + (
            _last_w_sql() if out == "final" else
            f"""SELECT t.model_id, CAST(v.epoch AS INTEGER) AS epoch, CAST(v.batch_id AS INTEGER) AS batch_id, {s6('t.loss')} AS batch_loss
                FROM steps t JOIN visits v ON v.s = t.s""")
        tail = None
    elif out == "final":
        tail = _final_w_sql(last)
    elif out == "snapshots":
        ends = {}
        for e, b, s in steps:
            ends[e] = s
        tail = " UNION ALL ".join(f"SELECT model_id, {e} AS epoch, feature_id, {s6('w')} AS w FROM w{s}" for e, s in ends.items())
    elif out == "steps":
        tail = " UNION ALL ".join(
            f"SELECT model_id, CAST(epoch AS INTEGER) AS epoch, CAST(batch_id AS INTEGER) AS batch_id, {s6('loss')} AS batch_loss FROM ls{s}"
            for e, b, s in steps)
    elif out == "monitor":
        per_epoch = " UNION ALL ".join(f"SELECT model_id, epoch, loss FROM ls{s}" for e, b, s in steps)
        tail = f"""SELECT model_id, CAST(epoch AS INTEGER) AS epoch, {s6('loss')} AS loss,
            abs(coalesce(lag(loss) OVER (PARTITION BY model_id ORDER BY epoch), 0.0) - loss) < 1e-6 AS converged,
            (isnan(loss) OR isinf(loss)) AS overflow
            FROM (SELECT model_id, epoch, sum(loss) / (SELECT n FROM ntr) AS loss FROM ({per_epoch}) t GROUP BY model_id, epoch) u"""
    else:
        raise ValueError(out)
    if tail is not None:
        sql = with_(*base, *ctes, materialize=True) + tail

    def run(spark, sf):
        wide = li_model_data(spark, sf) if data == "li" else emb_model_data(spark, sf)
        ms = [L.Model(**vars(m)) for m in models]
        res = L.train(_train_vec(wide), width, ms, batch, epochs, decay=decay, shuffle_seed=shuffle, rows_per_chunk=rows_per_chunk)
        if out == "final":
            return _weights_out(spark, res, ms, [epochs])
        if out == "snapshots":
            return _weights_out(spark, res, ms, None, with_epoch=True)
        if out == "steps":
            return L.steps_frame(res).select("model_id", "epoch", F.col("batch_id").cast("int").alias("batch_id"), r6(F.col("batch_loss")).alias("batch_loss"))
        h = L.history_frame(res)
        return h.select("model_id", "epoch", r6(F.col("loss")).alias("loss"), "converged", "overflow")

    QUERIES[name] = run
    ORACLE[name] = sql
    return run


_train_query("sgd_update", [L.Model(0, "linear", 0.1, 0.0, 1.0), L.Model(1, "linear", 0.05, 1.0, 2.0),
                            L.Model(2, "linear", 0.2, 10.0, 0.5)], "li", 2, FULL, LI_D)
_train_query("sgd_update_penalty", [L.Model(0, "linear", 0.5, 50.0, 1.0, "l2"), L.Model(1, "linear", 0.5, 50.0, 1.0, "l1"),
                                    L.Model(2, "linear", 0.5, 50.0, 1.0, "none")], "li", 3, FULL, LI_D)
_train_query("learning_rate_decay", [L.Model(0, "linear", 0.5, 0.0, 1.0)], "li", 11, FULL, LI_D, decay=True)
_train_query("epoch_monitor", [L.Model(0, "linear", 0.5), L.Model(1, "cube", 0.5), L.Model(2, "origin", 0.5)],
             "li", 4, FULL, LI_D, out="monitor")
_train_query("train_binary", [L.Model(0, "linear", 0.1, 1.0, 1.0)], "li", 2, MINI, LI_D)
_train_query("taylor_loss", [L.Model(0, "linear", 0.1, 1.0, 1.0), L.Model(1, "origin", 0.1, 1.0, 1.0)],
             "li", 2, MINI, LI_D, out="steps")
_train_query("train_shuffled_order", [L.Model(0, "linear", 0.1, 1.0, 1.0), L.Model(1, "cube", 0.2, 0.0, 1.0)], "li", 3, 512, LI_D, shuffle=3)
_train_query("weight_snapshots", [L.Model(0, "linear", 0.5)], "li", 3, FULL, LI_D, out="snapshots")
OVR_MODELS = [L.Model(k, "linear", 0.5, 0.0, 1.0, pos_label=k) for k in range(10)]
_train_query("train_ovr", OVR_MODELS, "emb", 3, FULL, EMB_D)


# ------------------------------------------------------------ G12 + H1
GRID = [(sig, a, lam) for sig in ("linear", "cube") for a in (0.1, 0.5) for lam in (0.0, 1.0)]
GRID_MODELS = [L.Model(i, sig, a, lam, 1.0) for i, (sig, a, lam) in enumerate(GRID)]
GRID_EPOCHS = 2


def _score_sql(snap_ctes: str) -> str:
    """zt(row_id, model_id, epoch, z) on test rows for the weights in ``snap``."""
    return f"""SELECT r.row_id, s.model_id, s.epoch, coalesce(sum(x.value * s.w), 0.0) AS z
        FROM vr r CROSS JOIN (SELECT DISTINCT model_id, epoch FROM {snap_ctes}) k
        LEFT JOIN vx x ON x.row_id = r.row_id
        LEFT JOIN {snap_ctes} s ON s.model_id = k.model_id AND s.epoch = k.epoch AND s.feature_id = x.feature_id
        GROUP BY r.row_id, s.model_id, s.epoch"""


def _grid_sql() -> str:
    ctes, steps = sql_train(GRID_MODELS, LI_D, GRID_EPOCHS, 1)
    last = steps[-1][2]
    sigs = " ".join(f"WHEN {m.model_id} THEN '{m.activation}'" for m in GRID_MODELS)
    zt = f"""SELECT r.row_id, k.model_id, coalesce(sum(x.value * w.w), 0.0) AS z
        FROM vr r CROSS JOIN mods k LEFT JOIN vx x ON x.row_id = r.row_id
        LEFT JOIN w{last} w ON w.model_id = k.model_id AND w.feature_id = x.feature_id GROUP BY r.row_id, k.model_id"""
    return with_(*sql_li_model(FULL), *ctes, ("zt", zt), materialize=True) + f"""
SELECT z.model_id AS run_id, CASE z.model_id {sigs} END AS sigmoid_func, m.alpha, m.lam AS lambda_para, m.c,
       {s6(f"avg(CASE WHEN (CASE WHEN {_act_case(GRID_MODELS, 'z.z', 'z.model_id')} >= 0.5 THEN 1 ELSE 0 END) = r.label THEN 1.0 ELSE 0.0 END)")} AS accuracy
FROM zt z JOIN vr r ON z.row_id = r.row_id JOIN mods m ON m.model_id = z.model_id
GROUP BY z.model_id, m.alpha, m.lam, m.c"""


@q("grid_sweep", _grid_sql())
def _grid_sweep(spark, sf):
    from skein.operators.sweep import grid_models, sweep

    wide = li_model_data(spark, sf)
    cells, rows = _test_cells(wide)
    models = grid_models(sigmoids=["linear", "cube"], alphas=[0.1, 0.5], lambdas=[0.0, 1.0], cs=[1.0])
    acc = sweep(_train_vec(wide), LI_D, models, FULL, GRID_EPOCHS, cells, rows)
    return acc.select("run_id", "sigmoid_func", "alpha", "lambda_para", "c", r6(F.col("accuracy")).alias("accuracy"))


PRED_MODELS = [L.Model(0, "linear", 0.5)]


def _pred_sql() -> str:
    ctes, steps = sql_train(PRED_MODELS, LI_D, 3, 1)
    snap = " UNION ALL ".join(f"SELECT model_id, {e} AS epoch, feature_id, w FROM w{s}" for e, b, s in steps)
    return with_(*sql_li_model(FULL), *ctes, ("snap", snap), ("zt", _score_sql("snap")), materialize=True) + f"""
SELECT row_id, CAST(epoch AS INTEGER) AS epoch, {s6('z')} AS z,
       CASE WHEN {sql_activation('z', 'linear')} >= 0.5 THEN 1 ELSE 0 END AS pred FROM zt"""


@q("predict_binary", _pred_sql())
def _predict_binary(spark, sf):
    wide = li_model_data(spark, sf)
    ms = [L.Model(**vars(m)) for m in PRED_MODELS]
    res = L.train(_train_vec(wide), LI_D, ms, FULL, 3)
    cells, rows = _test_cells(wide)
    z = H.scores(cells, rows, L.weights_frame(res))
    p = H.predict_binary(z, rows, "linear")
    return p.select("row_id", "epoch", r6(F.col("z")).alias("z"), "pred")


OVR_EPOCHS = 5


def _ovr_eval_sql(out: str) -> str:
    ctes, steps = sql_train(OVR_MODELS, EMB_D, OVR_EPOCHS, 1)
    snap = " UNION ALL ".join(f"SELECT model_id, {e} AS epoch, feature_id, w FROM w{s}" for e, b, s in steps)
    pred = """SELECT row_id, epoch, arg_max(model_id, (p, -model_id)) AS pred FROM (
        SELECT row_id, epoch, model_id, (z * 0.25 + 0.5) AS p FROM zt) t GROUP BY row_id, epoch"""
    base = with_(*sql_emb_model(), *ctes, ("snap", snap), ("zt", _score_sql("snap")), ("pr", pred), materialize=True)
    if out == "pred":
        return base + "SELECT row_id, CAST(epoch AS INTEGER) AS epoch, CAST(pred AS INTEGER) AS pred FROM pr"
    return base + f"""SELECT CAST(epoch AS INTEGER) AS epoch, {s6('acc')} AS accuracy,
        CASE WHEN epoch = first(epoch ORDER BY acc DESC, epoch ASC) OVER () THEN 1 ELSE 0 END AS is_best
        FROM (SELECT p.epoch, avg(CASE WHEN p.pred = r.label THEN 1.0 ELSE 0.0 END) AS acc
              FROM pr p JOIN vr r ON p.row_id = r.row_id GROUP BY p.epoch) a"""


def _ovr_trained(spark, sf):
    wide = emb_model_data(spark, sf)
    res = L.train(_train_vec(wide), EMB_D, OVR_MODELS, FULL, OVR_EPOCHS)
    return (*_test_cells(wide), L.weights_frame(res))


@q("predict_ovr", _ovr_eval_sql("pred"))
def _predict_ovr(spark, sf):
    pred = H.ovr_predictions(*_ovr_trained(spark, sf), "linear")
    return pred.select("row_id", "epoch", F.col("pred").cast("int"))


@q("accuracy_by_epoch", _ovr_eval_sql("acc"))
def _accuracy_by_epoch(spark, sf):
    acc = H.mark_best(H.ovr_epoch_accuracy(*_ovr_trained(spark, sf), "linear"))
    return acc.select("epoch", r6(F.col("accuracy")).alias("accuracy"), "is_best")


# ------------------------------------------------------------ H4
def _leader_sql() -> str:
    return with_(("run_lines", X.SQL_RUN_LINES)) + """
, per AS (
  SELECT run_name,
         arg_max(CASE WHEN regexp_extract(line, '^best_acc=(.*)$', 1) <> ''
                      THEN CAST(regexp_extract(line, '^best_acc=(.*)$', 1) AS DOUBLE) END,
                 CASE WHEN regexp_extract(line, '^best_acc=(.*)$', 1) <> '' THEN line_no END) AS best_acc,
         arg_max(CASE WHEN regexp_extract(line, '^best_epoch=(.*)$', 1) <> ''
                      THEN CAST(regexp_extract(line, '^best_epoch=(.*)$', 1) AS INTEGER) END,
                 CASE WHEN regexp_extract(line, '^best_epoch=(.*)$', 1) <> '' THEN line_no END) AS best_epoch
  FROM run_lines GROUP BY run_name)
SELECT run_name, best_acc, best_epoch, CAST(dense_rank() OVER (ORDER BY best_acc DESC) AS INTEGER) AS rank FROM per"""


@q("sweep_leaderboard", _leader_sql())
def _sweep_leaderboard(spark, sf):
    runs = parse_run_logs(X.run_lines(spark, sf))
    return H.leaderboard(runs).select("run_name", "best_acc", "best_epoch", F.col("rank").cast("int"))



# ------------------------------------------------------------ sketches -> model (F16 -> F8 -> G9 -> H1/H3)
SK_C = 4               # hash squeeze of P-MinHash samples
SK_B = 2               # b-bit squeeze of 0-bit CWS samples
SK_EPOCHS = 3
SK_MODELS = [L.Model(0, "linear", 0.5)]


def _sketch_model_sql(method: str = "pminhash") -> str:
    from skein.operators import squeeze as Q
    from skein.plans import sketch_queries as SQ

    if method == "pminhash":
        a, b = Q.hash_params(SK_C, SQ.KH, SQ.SEED)
        enc = SQ._indep_hash_sql(SK_C, a, b)
        width = sum(Q.independent_width(SQ.N1, SQ.N2, SQ.K1, SQ.K2, c=SK_C))
    else:
        w = 2**SK_B
        enc = f"{w} * hash_id + {w} - ((sample % {w}) + 1) + CASE WHEN party = 2 THEN {w * SQ.K1} ELSE 0 END"
        width = sum(Q.independent_width(SQ.N1, SQ.N2, SQ.K1, SQ.K2, b=SK_B))
    ctes, steps = sql_train(SK_MODELS, width, SK_EPOCHS, 1)
    snap = " UNION ALL ".join(f"SELECT model_id, {e} AS epoch, feature_id, w FROM w{s}" for e, bb, s in steps)
    base = [
        *SQ.DOC_BASE, *SQ.sql_samples(method),
        ("sk", f"SELECT row_id, CAST({enc} + 1 AS INTEGER) AS feature_id, 1.0::DOUBLE AS value FROM s_samples WHERE sample NOT IN (-1, 0)"),
        ("lab", """SELECT row_id, label, CASE WHEN rn <= m - CAST(ceil(0.2 * m) AS BIGINT) THEN 'train' ELSE 'test' END AS split
            FROM (SELECT row_id, label, row_number() OVER (ORDER BY row_id) AS rn, count(*) OVER () AS m
                  FROM doc_rows WHERE label IS NOT NULL) t"""),
        ("tx", "SELECT s.row_id, s.feature_id, s.value FROM sk s JOIN lab l ON s.row_id = l.row_id WHERE l.split = 'train'"),
        ("tr", "SELECT row_id, label, 0 AS batch_id, count(*) OVER () AS bsz FROM lab WHERE split = 'train'"),
        ("vx", "SELECT s.row_id, s.feature_id, s.value FROM sk s JOIN lab l ON s.row_id = l.row_id WHERE l.split = 'test'"),
        ("vr", "SELECT row_id, label FROM lab WHERE split = 'test'"),
    ]
    return with_(*base, *ctes, ("snap", snap), ("zt", _score_sql("snap")), materialize=True) + f"""
SELECT CAST(epoch AS INTEGER) AS epoch,
       {s6(f"avg(CASE WHEN (CASE WHEN {sql_activation('z.z', 'linear')} >= 0.5 THEN 1 ELSE 0 END) = r.label THEN 1.0 ELSE 0.0 END)")} AS accuracy
FROM zt z JOIN vr r ON z.row_id = r.row_id GROUP BY epoch"""


def _sketch_logistic(spark, sf, method):
    from skein.operators import squeeze as Q
    from skein.plans import sketch_queries as SQ
    from skein.session import cut_lineage

    rows = R.split_ordered(X.doc_rows(spark, sf).where(F.col("label").isNotNull()))
    # only labelled documents are tokenised and sampled
    labelled = rows.select("row_id")
    draw, size, how = (SM.pminhash_samples, SK_C, {"c": SK_C}) if method == "pminhash" else (SM.cws_samples, SK_B, {"b": SK_B})
    samples = draw(X.doc_vectors(spark, sf, only=labelled), labelled, SQ.N, SQ.KH, SQ.P, seed=SQ.SEED)
    sk = Q.squeeze(samples, method, size, SQ.N, SQ.P, SQ.KH)          # re-cut at the party border
    w1, w2 = Q.independent_width(SQ.N1, SQ.N2, SQ.K1, SQ.K2, **how)
    cells = sk.select("row_id", (F.col("col") + 1 + F.when(F.col("party") == 2, F.lit(w1)).otherwise(F.lit(0)))
                      .cast("int").alias("feature_id"), F.lit(1.0).alias("value"))
    cells = cut_lineage(cells)  # rows x k ones, read by training and by scoring
    train_rows = rows.where(F.col("split") == "train").select("row_id", "label")
    test_rows = rows.where(F.col("split") == "test").select("row_id", "label")
    vec = L.vectors_from_cells(cells.join(train_rows.select("row_id"), "row_id", "left_semi"), train_rows)
    res = L.train(vec, w1 + w2, SK_MODELS, FULL, SK_EPOCHS)
    test_cells = cells.join(test_rows.select("row_id"), "row_id", "left_semi")
    acc = H.binary_accuracy(test_cells, test_rows, L.weights_frame(res), "linear")
    return acc.select("epoch", r6(F.col("accuracy")).alias("accuracy"))


@q("sketch_logistic_accuracy", _sketch_model_sql())
def _sketch_logistic_accuracy(spark, sf):
    return _sketch_logistic(spark, sf, "pminhash")


@q("cws_logistic_accuracy", _sketch_model_sql("0bitcws"))
def _cws_logistic_accuracy(spark, sf):
    """0-bit CWS samples, b-bit squeezed, through the trainer."""
    return _sketch_logistic(spark, sf, "0bitcws")


# ------------------------------------------------------------ kernel features -> one-vs-rest models
KERNEL_EPOCHS = 2


def _kernel_model_sql(features: str) -> str:
    from skein.plans import sketch_queries as SQ

    ctes, steps = sql_train(OVR_MODELS, SQ.KERNEL_K, KERNEL_EPOCHS, 1)
    snap = " UNION ALL ".join(f"SELECT model_id, {e} AS epoch, feature_id, w FROM w{s}" for e, b, s in steps)
    pred = """SELECT row_id, epoch, arg_max(model_id, (p, -model_id)) AS pred FROM (
        SELECT row_id, epoch, model_id, (z * 0.25 + 0.5) AS p FROM zt) t GROUP BY row_id, epoch"""
    base = [("kf", SQ.ORACLE[features]),
            ("fx", f"SELECT row_id, CAST(comp + 1 + CASE WHEN party = 2 THEN {SQ.KK1} ELSE 0 END AS INTEGER) AS feature_id, value FROM kf WHERE value <> 0"),
            *emb_split_sql(),
            ("tx", "SELECT f.* FROM fx f JOIN emb_split s ON f.row_id = s.row_id WHERE s.split = 'train'"),
            ("tr", "SELECT row_id, label, 0 AS batch_id, count(*) OVER () AS bsz FROM emb_split WHERE split = 'train'"),
            ("vx", "SELECT f.* FROM fx f JOIN emb_split s ON f.row_id = s.row_id WHERE s.split = 'test'"),
            ("vr", "SELECT row_id, label FROM emb_split WHERE split = 'test'")]
    return with_(*base, *ctes, ("snap", snap), ("zt", _score_sql("snap")), ("pr", pred), materialize=True) + f"""
SELECT CAST(p.epoch AS INTEGER) AS epoch, {s6('avg(CASE WHEN p.pred = r.label THEN 1.0 ELSE 0.0 END)')} AS accuracy
FROM pr p JOIN vr r ON p.row_id = r.row_id GROUP BY p.epoch"""


def _kernel_logistic(spark, sf, features: str):
    """Both parties' kernel features side by side, through the trainer."""
    from skein.plans import sketch_queries as SQ
    from skein.session import cut_lineage

    cells = cut_lineage(SQ.QUERIES[features](spark, sf).where(F.col("value") != 0).select(
        "row_id", (F.col("comp") + 1 + F.when(F.col("party") == 2, SQ.KK1).otherwise(0)).cast("int").alias("feature_id"), "value"))
    rows = emb_split(spark, sf).select("row_id", "label", "split")
    train_rows, test_rows = (rows.where(F.col("split") == x).select("row_id", "label") for x in ("train", "test"))
    vec = L.vectors_from_cells(cells.join(train_rows.select("row_id"), "row_id", "left_semi"), train_rows)
    res = L.train(vec, SQ.KERNEL_K, OVR_MODELS, FULL, KERNEL_EPOCHS)
    acc = H.ovr_epoch_accuracy(cells.join(test_rows.select("row_id"), "row_id", "left_semi"), test_rows, L.weights_frame(res), "linear")
    return acc.select("epoch", r6(F.col("accuracy")).alias("accuracy"))


@q("rff_logistic_accuracy", _kernel_model_sql("rff_features"))
def _rff_logistic_accuracy(spark, sf):
    return _kernel_logistic(spark, sf, "rff_features")


@q("tensor_sketch_logistic_accuracy", _kernel_model_sql("tensor_sketch_features"))
def _tensor_sketch_logistic_accuracy(spark, sf):
    return _kernel_logistic(spark, sf, "tensor_sketch_features")


# ------------------------------------------------------------ train -> evaluate -> log -> rank
FLOW_MODELS = [L.Model(i, sig, a, 0.0, 1.0) for i, (sig, a) in enumerate((s, a) for s in ("linear", "cube") for a in (0.1, 0.5, 2.0))]
FLOW_EPOCHS = 3


def _flow_sql() -> str:
    ctes, steps = sql_train(FLOW_MODELS, LI_D, FLOW_EPOCHS, 1)
    snap = " UNION ALL ".join(f"SELECT model_id, {e} AS epoch, feature_id, w FROM w{s}" for e, b, s in steps)
    hit = f"CASE WHEN (CASE WHEN {_act_case(FLOW_MODELS, 'z.z', 'z.model_id')} >= 0.5 THEN 1 ELSE 0 END) = r.label THEN 1.0 ELSE 0.0 END"
    return with_(*sql_li_model(FULL), *ctes, ("snap", snap), ("zt", _score_sql("snap")),
                 ("acc", f"SELECT z.model_id, z.epoch, avg({hit}) AS accuracy FROM zt z JOIN vr r ON z.row_id = r.row_id GROUP BY z.model_id, z.epoch"),
                 ("run", """SELECT model_id, max(accuracy) AS best_acc, arg_max(epoch, (accuracy, -epoch)) AS best_epoch, count(*) AS n,
                    sum(accuracy) AS total FROM acc GROUP BY model_id"""), materialize=True) + f"""
SELECT r.model_id AS run_id, m.alpha, CAST({FLOW_EPOCHS} AS INTEGER) AS max_iter, CAST(r.n AS INTEGER) AS epochs, {s6('r.total')} AS accuracy_sum,
  {s6('r.best_acc')} AS best_acc, CAST(r.best_epoch AS INTEGER) AS best_epoch, CAST(dense_rank() OVER (ORDER BY r.best_acc DESC) AS INTEGER) AS rank
FROM run r JOIN mods m ON m.model_id = r.model_id"""


@q("sweep_runs_leaderboard", _flow_sql())
def _sweep_runs_leaderboard(spark, sf):
    """A sweep whose runs are evaluated per epoch, appended as records, read
    back and ranked."""
    from skein.session import scratch_path
    from skein.sources import runlog as RL

    wide = li_model_data(spark, sf)
    res = L.train(_train_vec(wide), LI_D, FLOW_MODELS, FULL, FLOW_EPOCHS)
    acc = H.binary_accuracy(*_test_cells(wide), L.weights_frame(res), {m.model_id: m.activation for m in FLOW_MODELS})
    params = spark.createDataFrame([(m.model_id, m.activation, m.alpha, m.lambda_para, m.c) for m in FLOW_MODELS],
                                   "model_id long, sigmoid_func string, alpha double, lambda_para double, c double")
    root = scratch_path(spark, "sweep-runs")
    RL.append_runs(RL.run_records(acc, params, FLOW_EPOCHS), root, "li")
    board = H.leaderboard(RL.read_runs(spark, root, "li"))
    return board.select(F.col("model_id").alias("run_id"), "alpha", "max_iter", F.size("accuracy_lst").alias("epochs"),
                        r6(F.aggregate("accuracy_lst", F.lit(0.0), lambda a, x: a + x)).alias("accuracy_sum"),
                        r6(F.col("best_acc")).alias("best_acc"), "best_epoch", "rank")


# ------------------------------------------------------------ G9 with the reference's batch size (20)
SMALL_BATCH = 20
SMALL_BATCH_MODELS = [L.Model(0, "linear", 0.1, 1.0, 1.0)]
_train_query("train_binary_small_batch", SMALL_BATCH_MODELS, "li", 1, SMALL_BATCH, LI_D)


# ------------------------------------------------------------ G9 with linear models in chunks side by side
CHUNK_MODELS = [L.Model(0, "linear", 0.1, 1.0, 1.0), L.Model(1, "linear", 0.5, 0.0, 0.5, "none")]
CHUNK_BATCH, CHUNK_ROWS = 64, 1000
_train_query("train_linear_chunks", CHUNK_MODELS, "li", 2, CHUNK_BATCH, LI_D, rows_per_chunk=CHUNK_ROWS)
_train_query("train_linear_chunk_steps", CHUNK_MODELS, "li", 2, CHUNK_BATCH, LI_D, out="steps", rows_per_chunk=CHUNK_ROWS)


# ------------------------------------------------------------ G8/G9 stop on convergence
CONV_EPS = 3e-7
CONV_MAX_ITER = 8
CONV_MODELS = [L.Model(i, "linear", a) for i, a in enumerate((0.5, 0.01, 0.1))]  # they stop at different epochs


def _converge_sql() -> str:
    ctes, steps = sql_train(CONV_MODELS, LI_D, CONV_MAX_ITER, 1)
    per_epoch = " UNION ALL ".join(f"SELECT model_id, {e} AS epoch, loss FROM ls{s}" for e, b, s in steps)
    snap = " UNION ALL ".join(f"SELECT model_id, {e} AS epoch, feature_id, w FROM w{s}" for e, b, s in steps)
    return with_(*sql_li_model(FULL), *ctes,
                 ("el", f"SELECT model_id, epoch, sum(loss) / (SELECT n FROM ntr) AS loss FROM ({per_epoch}) t GROUP BY model_id, epoch"),
                 ("cv", f"""SELECT model_id, epoch,
                      abs(coalesce(lag(loss) OVER (PARTITION BY model_id ORDER BY epoch), 0.0) - loss) < {CONV_EPS!r} AS conv FROM el"""),
                 ("stop", f"SELECT model_id, coalesce(min(epoch) FILTER (WHERE conv), {CONV_MAX_ITER}) AS stop_epoch FROM cv GROUP BY model_id"),
                 ("snap", snap), materialize=True) + f"""
SELECT s.model_id, CAST(p.stop_epoch AS INTEGER) AS stop_epoch, s.feature_id, {s6('s.w')} AS w
FROM snap s JOIN stop p ON s.model_id = p.model_id AND s.epoch = p.stop_epoch"""


@q("train_converge", _converge_sql())
def _train_converge(spark, sf):
    wide = li_model_data(spark, sf)
    ms = [L.Model(**vars(m)) for m in CONV_MODELS]
    res = L.train(_train_vec(wide), LI_D, ms, FULL, CONV_MAX_ITER, eps=CONV_EPS, stop_on_converge=True)
    stops = {}
    for h in res.history:
        stops[h["model_id"]] = h["epoch"]
    table = spark.createDataFrame(list(stops.items()), "model_id long, stop_epoch int")
    return res.weights.join(F.broadcast(table), "model_id").select("model_id", "stop_epoch", "feature_id", r6(F.col("w")).alias("w"))


# ------------------------------------------------------------ H2 with negatives clipped before the arg-max
CLIP_MODELS = [L.Model(k, "cube", 2.0, 0.0, 1.0, pos_label=k) for k in range(10)]
CLIP_EPOCHS = 2


def _clip_sql() -> str:
    ctes, steps = sql_train(CLIP_MODELS, EMB_D, CLIP_EPOCHS, 1)
    snap = " UNION ALL ".join(f"SELECT model_id, {e} AS epoch, feature_id, w FROM w{s}" for e, b, s in steps)
    pred = f"""SELECT row_id, epoch, arg_max(model_id, (p, -model_id)) AS pred FROM (
        SELECT row_id, epoch, model_id, greatest({sql_activation('z', 'cube')}, 0.0) AS p FROM zt) t GROUP BY row_id, epoch"""
    return with_(*sql_emb_model(), *ctes, ("snap", snap), ("zt", _score_sql("snap")), ("pr", pred), materialize=True) + \
        "SELECT row_id, CAST(epoch AS INTEGER) AS epoch, CAST(pred AS INTEGER) AS pred FROM pr"


@q("predict_ovr_clip", _clip_sql())
def _predict_ovr_clip(spark, sf):
    wide = emb_model_data(spark, sf)
    ms = [L.Model(**vars(m)) for m in CLIP_MODELS]
    res = L.train(_train_vec(wide), EMB_D, ms, FULL, CLIP_EPOCHS)
    cells, rows = _test_cells(wide)
    pred = H.ovr_predictions(cells, rows, L.weights_frame(res), "cube", clip=True)
    return pred.select("row_id", "epoch", F.col("pred").cast("int"))


# ------------------------------------------------------------ G12 over batch sizes too
GRID_B = {"batch_size": [MINI, FULL], "sigmoid_func": ["linear", "cube"], "alpha": [0.1], "lambda_para": [0.0, 1.0],
          "c": [1.0]}


def _grid_batches_sql() -> str:
    from skein.operators.sweep import grid_models

    parts, ctes, start = [], [], 0
    for gi, bs in enumerate(GRID_B["batch_size"]):
        models = grid_models(GRID_B["sigmoid_func"], GRID_B["alpha"], GRID_B["lambda_para"], GRID_B["c"], start=start)
        start += len(models)
        pre = f"g{gi}_"
        sigs = " ".join(f"WHEN {m.model_id} THEN '{m.activation}'" for m in models)
        zt = f"""SELECT r.row_id, k.model_id, coalesce(sum(x.value * w.w), 0.0) AS z
            FROM vr r CROSS JOIN {pre}mods k LEFT JOIN vx x ON x.row_id = r.row_id
            LEFT JOIN (SELECT * FROM {pre}w WHERE s = (SELECT max(s) FROM {pre}visits)) w
              ON w.model_id = k.model_id AND w.feature_id = x.feature_id GROUP BY r.row_id, k.model_id"""
        ctes += [*sql_train_steps(models, LI_D, GRID_EPOCHS, bs, prefix=pre), (f"{pre}zt", zt)]
        parts.append(f"""SELECT z.model_id AS run_id, CASE z.model_id {sigs} END AS sigmoid_func, m.alpha, m.lam AS lambda_para, m.c,
            {s6(f"avg(CASE WHEN (CASE WHEN {_act_case(models, 'z.z', 'z.model_id')} >= 0.5 THEN 1 ELSE 0 END) = r.label THEN 1.0 ELSE 0.0 END)")} AS accuracy,
            CAST({bs} AS INTEGER) AS batch_size
            FROM {pre}zt z JOIN vr r ON z.row_id = r.row_id JOIN {pre}mods m ON m.model_id = z.model_id
            GROUP BY z.model_id, m.alpha, m.lam, m.c""")
    return _steps_with(*sql_li_model(MINI), *ctes) + "\nUNION ALL\n".join(parts)


@q("grid_sweep_batches", _grid_batches_sql())
def _grid_sweep_batches(spark, sf):
    from skein.operators.sweep import sweep_grid

    wide = li_model_data(spark, sf)
    cells, rows = _test_cells(wide)
    acc = sweep_grid(_train_vec(wide), LI_D, GRID_B, GRID_EPOCHS, cells, rows)
    return acc.select("run_id", "sigmoid_func", "alpha", "lambda_para", "c", r6(F.col("accuracy")).alias("accuracy"),
                      F.col("batch_size").cast("int"))


# ------------------------------------------------------------ §4.3 #3: weights kept as a table
REL_MODELS = [L.Model(0, "linear", 0.1, 1.0, 1.0), L.Model(1, "cube", 0.2, 0.0, 2.0), L.Model(2, "origin", 0.3, 1.0, 1.0, "l1")]
REL_EPOCHS = 2


def _relational_sql() -> str:
    return _steps_with(*sql_li_model(MINI), *sql_train_steps(REL_MODELS, LI_D, REL_EPOCHS, MINI)) + _last_w_sql()


@q("train_relational_weights", _relational_sql())
def _train_relational_weights(spark, sf):
    """The relational trainer (used past the broadcast bound), run directly."""
    wide = li_model_data(spark, sf)
    ms = [L.Model(**vars(m)) for m in REL_MODELS]
    res = L.train_relational(_train_vec(wide), LI_D, ms, MINI, REL_EPOCHS)
    return res.weights.select("model_id", "feature_id", r6(F.col("w")).alias("w"))


# ------------------------------------------------------------ G10 on the three-class LI (F/O/P -> 0/1/2)
LI3_MODELS = [L.Model(k, "linear", 0.5, 0.0, 1.0, pos_label=k) for k in range(3)]
LI3_EPOCHS = 3


def _li3_sql() -> str:
    ctes, steps = sql_train(LI3_MODELS, LI_D, LI3_EPOCHS, 1)
    return with_(*sql_li_model(FULL, classes=3), *ctes, materialize=True) + _final_w_sql(steps[-1][2])


@q("train_ovr_li", _li3_sql())
def _train_ovr_li(spark, sf):
    wide = li_model_data(spark, sf, classes=3)
    ms = [L.Model(**vars(m)) for m in LI3_MODELS]
    res = L.train(_train_vec(wide), LI_D, ms, FULL, LI3_EPOCHS)
    return _weights_out(spark, res, ms, [LI3_EPOCHS])
