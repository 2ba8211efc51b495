"""Synthetic log generation as a Spark job.

Rows come from an id frame (`id` = 0..n-1, e.g. `spark.range(n)` or a table's dense
key), so generation is parallel and its size is set by data, not by a driver loop.
Every random choice is a seeded hash draw h01(seed, id, name): the same id always
gives the same line, whatever the partitioning or retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.hashing import h01, rand_choice, rand_int
from logsieve.sources import templates as T

# Placeholder domains, (name, kind, spec).
#   int:    inclusive range (lo, hi)
#   choice: list of values
#   fmt:    (prefix, lo, hi, suffix) -> prefix + integer + suffix
#   sample: (k, candidates) -> k different candidates, comma-joined
DOMAINS = [
    ("e", "int", (100, 200)),
    ("total", "int", (10, 20)),
    ("up", "int", (5, 10)),
    ("version", "int", (1000, 9999)),
    ("pgs", "int", (100, 500)),
    ("peering", "int", (0, 50)),
    ("active_clean", "int", (50, 500)),
    ("data", "int", (50000, 100000)),
    ("used", "int", (1, 100)),
    ("avail", "int", (1, 100)),
    ("command", "choice", ["status", "df", "osd tree", "mon_status", "auth list"]),
    ("client_id", "int", (1000, 9999)),
    ("network_id", "fmt", ("net-", 100, 999, "")),
    ("pg_id", "int", (100, 999)),
    ("osd_id", "int", (0, 10)),
    ("mon_id", "int", (0, 5)),
    ("mon_list", "sample", (3, ["mon.0", "mon.1", "mon.2", "mon.3", "mon.4"])),
    ("mds_id", "int", (0, 3)),
    ("rank", "int", (0, 3)),
    ("inode_count", "int", (1000, 100000)),
    ("method", "choice", ["GET", "PUT", "DELETE"]),
    ("bucket", "fmt", ("bucket-", 1, 20, "")),
    ("object_name", "fmt", ("object-", 100, 999, ".bin")),
    ("user", "fmt", ("user-", 1, 50, "")),
    ("rbd_image", "fmt", ("rbd-image-", 1, 10, "")),
    ("rbd_id", "int", (0, 10)),
    ("snapshot", "fmt", ("snap-", 100, 999, "")),
    ("error", "choice", ["crc_mismatch", "unknown", "bitflip"]),
    ("reason", "choice", ["permission_denied", "timeout", "disk_error", "stale_session"]),
    ("count", "int", (1, 10)),
    ("error_message", "choice", ["no heartbeat", "I/O error", "timeout"]),
    ("crash_reason", "choice", ["out of memory", "assert failed", "segfault"]),
    ("error_details", "choice", ["read error", "unmounted", "disk offline"]),
    ("time_period", "fmt", ("", 10, 120, "s")),
]
# Label tags, the anomaly period of labelled logs, the normal share and
# the time offset of anomalies in test logs, the time step of unlabelled logs.
LABEL_ANOMALY, LABEL_NORMAL = "ANOMALY", "NORMAL"
ANOMALY_EVERY = 20
TEST_NORMAL_SHARE = 0.9
TEST_ANOMALY_OFFSET_S = 90
RAW_STEP_S = 10
DEFAULT_BASE_TS = "2024-01-01 00:00:00"
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
MODES = ("raw", "finetuned", "test")


def placeholder_value(name: str, kind: str, spec, seed: int, key: Column) -> Column:
    h = h01(seed, key, name)
    if kind == "int":
        return rand_int(h, *spec).cast("string")
    if kind == "choice":
        return rand_choice(h, spec)
    if kind == "fmt":
        pre, lo, hi, suf = spec
        return F.concat(F.lit(pre), rand_int(h, lo, hi).cast("string"), F.lit(suf))
    if kind == "sample":
        k, cands = spec
        keyed = F.array(*[F.struct(h01(seed, key, name, i).alias("h"), F.lit(c).alias("v"))
                          for i, c in enumerate(cands)])
        return F.array_join(F.slice(F.sort_array(keyed), 1, k).getField("v"), ",")
    raise ValueError(kind)


def fill_template(text: Column, seed: int, key: Column) -> Column:
    """Replace every `{name}` by one draw per (row, name); repeats get the same value."""
    out = text
    for name, kind, spec in DOMAINS:
        out = F.replace(out, F.lit("{" + name + "}"), placeholder_value(name, kind, spec, seed, key))
    return out


def pick_template(templates: list, seed: int, key: Column, draw: str = "tpl") -> Column:
    return rand_choice(h01(seed, key, draw), templates)


def _ts(base_ts: str, seconds: Column) -> Column:
    t = F.lit(base_ts).cast("timestamp_ntz")
    return F.date_format(F.timestamp_add("SECOND", seconds, t), TS_FORMAT)


def generate_logs(ids: DataFrame, mode: str = "raw", seed: int = 0, base_ts: str = DEFAULT_BASE_TS,
                  id_col: str = "id") -> DataFrame:
    """(log_id, line[, position]) for every id.

    raw:        time base + 10 i s, uniform over the unlabelled normal templates
    finetuned:  i % 20 == 0 -> anomaly template + ` ##ANOMALY`, else normal + ` ##NORMAL`;
                time base + U{1,2,3} * i s (not monotone)
    test:       the first floor(0.9 n) ids normal at base + i s, the rest anomalous at
                base + 90 + j s; `position` = place in a seeded shuffle of all lines
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    i = F.col(id_col)
    if mode == "raw":
        tpl = pick_template(T.NORMAL_UNLABELLED, seed, i)
        line = F.concat(_ts(base_ts, i * RAW_STEP_S), F.lit(" "), fill_template(tpl, seed, i))
        return ids.select(i.alias("log_id"), line.alias("line"))
    if mode == "finetuned":
        anomalous = (i % ANOMALY_EVERY) == 0
        tpl = F.when(anomalous, pick_template(T.ANOMALY_LABELLED, seed, i)).otherwise(
            pick_template(T.NORMAL_LABELLED, seed, i))
        step = rand_int(h01(seed, i, "step"), 1, 3)
        tag = F.when(anomalous, F.lit(" ##" + LABEL_ANOMALY)).otherwise(F.lit(" ##" + LABEL_NORMAL))
        line = F.concat(_ts(base_ts, step * i), F.lit(" "), fill_template(tpl, seed, i), tag)
        return ids.select(i.alias("log_id"), line.alias("line"))
    # test: the split point depends on n -- a one-row aggregate attached to every row
    from logsieve.operators.prep import with_global_index
    n = ids.agg(F.floor(F.count(F.lit(1)) * F.lit(TEST_NORMAL_SHARE)).alias("_nn"))
    # number the shuffled order on (id, draw) only; lines are built once, afterwards
    keyed = ids.select(i.alias("log_id"), h01(seed, i, "shuffle").alias("_h"))
    d = with_global_index(keyed, ["_h", "log_id"], "position").crossJoin(F.broadcast(n))
    i = F.col("log_id")
    normal = i < F.col("_nn")
    tpl = F.when(normal, pick_template(T.NORMAL_TEST, seed, i)).otherwise(pick_template(T.ANOMALY_TEST, seed, i))
    secs = F.when(normal, i).otherwise(F.lit(TEST_ANOMALY_OFFSET_S) + i - F.col("_nn"))
    line = F.concat(_ts(base_ts, secs), F.lit(" "), fill_template(tpl, seed, i))
    return d.select("log_id", line.alias("line"), "position")
