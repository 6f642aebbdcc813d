"""Benchmark metrics over result rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.dataset import global_rank, in_blocks

# Report rows of spatial benchmarks (key, metric), and the question types that make up a macro mean.
SPACE_REPORT = (
    ("object_counting", "MRA"),
    ("object_abs_distance", "MRA"),
    ("object_size_estimation", "MRA"),
    ("room_size_estimation", "MRA"),
    ("object_rel_distance", "ACC"),
    ("object_rel_direction", "ACC"),
    ("route_planning", "ACC"),
    ("obj_appearance_order", "ACC"),
)
MACRO_MEMBERS = {
    "object_counting": ("single", "multiple"),
    "object_rel_direction": ("forward_easy", "backward_easy", "forward_hard", "backward_hard"),
    "object_rel_distance": ("closest", "farthest"),
    "room_size_estimation": ("single", "multiple"),
}


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to two places, 0 for an empty whole (A3)."""
    return F.when(whole == 0, 0.0).otherwise(F.round(100.0 * part / whole, 2))


def share(condition: Column) -> Column:
    """Rows that meet a condition in per cent, to two places; 0 of no rows."""
    return F.coalesce(F.round(F.avg(condition.cast("double")) * 100, 2), F.lit(0.0))


def mean_percent(value: Column) -> Column:
    return F.coalesce(F.round(F.avg(F.coalesce(value, F.lit(0.0))) * 100, 2), F.lit(0.0))


def _grouped(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """correct and total in all and by each key, in one pass: dimension, name, accuracy, correct, total."""
    named = df.select(
        *[F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown")).alias(k) for k, c in keys.items()],
        F.col("score").cast("int").cast("long").alias("_s"),
    )
    sets = [[], *[[k] for k in keys]]
    out = named.groupingSets(sets, *keys).agg(F.sum("_s").alias("correct"), F.count("*").alias("total"), F.grouping_id().alias("_g"))
    bit = lambda i: (2 ** len(keys) - 1) ^ (1 << (len(keys) - 1 - i))
    dimension = reduce(lambda acc, x: acc.when(F.col("_g") == bit(x[0]), F.lit("by_" + x[1])), list(enumerate(keys)), F.when(F.lit(False), ""))
    return out.select(
        dimension.otherwise("all").alias("dimension"), F.coalesce(*keys).alias("name"), percent(F.col("correct"), F.col("total")).alias("accuracy"), "correct", "total"
    )


def answer_rates(df: DataFrame) -> DataFrame:
    """Rows, and the shares with a parsed and with a true answer."""
    filled = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    n = F.count("*")
    return df.agg(n.alias("num_samples"), percent(filled("pred_answer"), n).alias("parse_rate"), percent(filled("answer"), n).alias("ground_truth_rate"))


def choice_accuracy(df: DataFrame, keys: dict[str, str], durations: tuple[str, ...] = ("short", "medium", "long")) -> DataFrame:
    """Accuracy in all and by keys (A4): a duration that is not listed drops out of by_duration only.

    Scores are cut to whole numbers, as correct answers are counted.
    """
    out = _grouped(df, keys)
    return out.where((F.col("dimension") != "by_duration") | F.col("name").isin(*durations)) if "duration" in keys else out


def group_accuracy(df: DataFrame, key: str = "group") -> DataFrame:
    """Accuracy by one key (A5)."""
    return _grouped(df, {"group": key}).where("dimension = 'by_group'").drop("dimension")


def macro_accuracy(groups: DataFrame) -> DataFrame:
    """Mean of the rounded group accuracies (A5)."""
    return groups.agg(F.round(F.avg("accuracy"), 2).alias("M_avg"))


def report_key(kind: Column) -> Column:
    return F.when(kind.startswith("object_rel_direction"), F.lit("object_rel_direction")).otherwise(kind)


def _averages(tasks: DataFrame, value: Column, scale: float = 1.0) -> DataFrame:
    numeric = F.col("metric") == "MRA"
    mean = lambda c: F.round(F.avg(c) * scale, 2)
    return tasks.agg(
        mean(F.when(numeric, value)).alias("numerical_avg"), mean(F.when(~numeric & (F.col("key") != "obj_appearance_order"), value)).alias("mc_avg_without_order"),
        mean(F.when(~numeric, value)).alias("mc_avg"), mean(value).alias("overall_avg"),
    )


def spatial_tasks(df: DataFrame, kind: str = "question_type") -> DataFrame:
    """Scores of the report rows (A6): direction types are pooled; key, metric, score, count."""
    report = df.sparkSession.createDataFrame(SPACE_REPORT, "key string, metric string")
    pooled = df.groupBy(report_key(F.col(kind)).alias("key")).agg(mean_percent(F.col("score")).alias("score"), F.count("*").alias("count"))
    return pooled.join(F.broadcast(report), "key").select("key", "metric", "score", "count")


def spatial_summary(tasks: DataFrame) -> DataFrame:
    """Averages of the rounded task scores."""
    return _averages(tasks, F.col("score")).drop("mc_avg_without_order")


def macro_tasks(df: DataFrame, kind: str = "question_type") -> DataFrame:
    """Report rows as means of the means of their question types (A7), not rounded: key, metric, mean, count."""
    rows = [(f"{k}_{m}", k) for k, members in MACRO_MEMBERS.items() for m in members]
    rows += [(k, k) for k, _ in SPACE_REPORT if k not in MACRO_MEMBERS]
    metric = {k: m for k, m in SPACE_REPORT}
    table = df.sparkSession.createDataFrame([(q, k, metric[k]) for q, k in rows if k != "obj_appearance_order"], "kind string, key string, metric string")
    types = df.groupBy(F.col(kind).alias("kind")).agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"), F.count("*").alias("n"))
    return types.join(F.broadcast(table), "kind").groupBy("key", "metric").agg(F.avg("mean").alias("mean"), F.sum("n").alias("count"))


def macro_summary(tasks: DataFrame) -> DataFrame:
    """Averages of the unrounded means."""
    return _averages(tasks, F.col("mean"), 100.0).drop("mc_avg_without_order")


def grounding_metrics(df: DataFrame, iou: str = "iou", parsed: Column | None = None, thresholds: tuple[float, ...] = (0.5, 0.7, 0.9), name: str = "acc") -> DataFrame:
    """Rows, mean IoU, parse rate and shares above thresholds."""
    x = F.coalesce(F.col(iou), F.lit(0.0))
    cuts = [share(x >= t).alias(f"{name}@{t}") for t in thresholds]
    return df.agg(F.count("*").alias("num_samples"), mean_percent(x).alias("mIoU"), share(F.col("parsed") if parsed is None else parsed).alias("parse_rate"), *cuts)


def tracking_metrics(df: DataFrame) -> DataFrame:
    """AO and R@t over frames, mIoU and sample_R@t over samples (A9), in one scan of samples."""
    frames = F.col("frame_ious")
    none = F.array().cast("array<double>")
    frames = F.coalesce(frames, none)
    m = F.coalesce(F.col("miou"), F.lit(0.0))
    n = F.sum(F.size(frames))
    over = lambda t: F.sum(F.size(F.filter(frames, lambda v: v >= t)))
    ratio = lambda c: F.coalesce(F.round(F.when(n > 0, c / n) * 100, 2), F.lit(0.0))
    total = F.sum(F.aggregate(frames, F.lit(0.0), lambda a, v: a + v))
    return df.agg(
        F.count("*").alias("num_samples"), F.coalesce(n, F.lit(0)).alias("num_frames"), ratio(total).alias("AO"),
        *[ratio(over(t)).alias(f"R@{t}") for t in (0.3, 0.5, 0.7)], mean_percent(m).alias("mIoU"),
        *[share(m >= t).alias(f"sample_R@{t}") for t in (0.3, 0.5, 0.7)], share(F.coalesce(F.col("pred_boxes_n"), F.lit(0)) > 0).alias("parse_rate"),
    )


def tube_metrics(df: DataFrame) -> DataFrame:
    """tIoU, sIoU, mIoU over common frames, accuracy and shares above thresholds (A10)."""
    t, s = F.coalesce("tiou", F.lit(0.0)), F.coalesce("siou", F.lit(0.0))
    parsed = F.col("pred_time").isNotNull() | (F.coalesce(F.col("pred_boxes_n"), F.lit(0)) > 0)
    cuts = [share(x >= c).alias(f"{n}@{c}") for c in (0.3, 0.5, 0.7) for n, x in (("tIoU", t), ("sIoU", s))]
    return df.agg(
        F.count("*").alias("num_samples"), mean_percent(t).alias("tIoU"), mean_percent(s).alias("sIoU"), mean_percent(F.col("miou_inter")).alias("mIoU_inter"),
        mean_percent(F.col("accuracy")).alias("mean_accuracy"), share(parsed).alias("parse_rate"), *cuts,
    )


def segmentation_metrics(df: DataFrame) -> DataFrame:
    """Means of J, F and J&F, gIoU and cIoU over rows whose status is ok."""
    ok = df.where("status = 'ok'")
    union = F.sum("union")
    return ok.agg(
        F.count("*").alias("num_samples"), F.avg("j").alias("J"), F.avg("f").alias("F"), F.avg("jf").alias("J&F"), F.avg("iou").alias("gIoU"),
        F.when(union > 0, F.sum("inter") / union).otherwise(0.0).alias("cIoU"),
    )


def merge_shards(shards: list[DataFrame], key: str = "id", line: str = "line") -> DataFrame:
    """Results of all shards, the last one written of each id (J4). Shards count in the order given."""
    rows = reduce(DataFrame.unionByName, [df.withColumn("_shard", F.lit(i)) for i, df in enumerate(shards)])
    last = Window.partitionBy(key).orderBy(F.col("_shard").desc(), F.col(line).desc())
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "_shard")


def numeric_ids_first(key: Column) -> list[Column]:
    """Sort keys that put whole-number ids first, by value."""
    return [F.when(key.rlike("^[0-9]+$"), 0).otherwise(1), F.when(key.rlike("^[0-9]+$"), key.cast("long")), key]


def remaining(tasks: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not in a partial result yet."""
    return tasks.join(done.select(key).distinct(), key, "left_anti")


def suite_status(expected: DataFrame, summaries: DataFrame, key: str = "task") -> DataFrame:
    """Every expected task as completed or missing."""
    seen = summaries.select(key).distinct().withColumn("_seen", F.lit(True))
    return expected.join(seen, key, "left").select(key, F.when(F.col("_seen"), "completed").otherwise("missing").alias("status"))


def nearest_frame(frames: DataFrame, asked: DataFrame, key: str, frame: str = "frame", time: str = "time") -> DataFrame:
    """asked with the frame nearest to its time under the same key (J8): an as-of join to both sides.

    Frames and times lie on one timeline that is cut into blocks, so a key may hold any share of the rows. A time takes
    the last frame before it and the first behind it from its block, else from the blocks around, of which there is a
    row for each key. Ties go to the lower frame. Times that are null or no number, and those of a key without frames,
    are left out; repeated ones stay.
    """
    place = lambda name: F.col(name).cast("double").alias("_at")
    shown = frames.select(F.col(key).alias("_key"), place(frame), F.lit(0).alias("_side"), F.col(frame).alias("_frame"))
    times = asked.select(F.col(key).alias("_key"), place(time), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in asked.columns]).alias("_row"))
    both = shown.unionByName(times, allowMissingColumns=True).where("_key IS NOT NULL AND _at IS NOT NULL AND NOT isnan(_at)")
    line = in_blocks(both, ["_key", "_at", "_side"])
    inside, order = Window.partitionBy("_key", "_b"), [F.col("_at"), F.col("_side")]
    until = Window.unboundedPreceding
    before = F.max("_frame").over(inside.orderBy(*order).rowsBetween(until, 0))
    behind = F.min("_frame").over(inside.orderBy(*[c.desc() for c in order]).rowsBetween(until, 0))
    heads = line.groupBy("_key", "_b").agg(F.min("_frame").alias("_low"), F.max("_frame").alias("_high"))
    blocks = Window.partitionBy("_key")
    carried = heads.select(
        "_key", "_b", F.max("_high").over(blocks.orderBy("_b").rowsBetween(until, -1)).alias("_left"),
        F.min("_low").over(blocks.orderBy(F.col("_b").desc()).rowsBetween(until, -1)).alias("_right"),
    )
    found = line.select("*", before.alias("_before"), behind.alias("_behind")).where("_side = 1").join(carried, ["_key", "_b"])
    left, right = F.coalesce("_before", "_left"), F.coalesce("_behind", "_right")
    nearer = F.when(right.isNull() | (F.col("_at") - left <= right - F.col("_at")), left).otherwise(right)
    return found.select("_row.*", F.coalesce(nearer, right).alias(frame)).where(F.col(frame).isNotNull())


def in_video_order(df: DataFrame, video: tuple[str, ...] = ("videoID", "video_id"), question: tuple[str, ...] = ("question_id", "id")) -> DataFrame:
    """Samples by video, then question, with their ``place`` from 0 (Q6).

    Of the names given the first with a text that is not empty counts; names that are no columns are passed over. Equal
    samples stand in any order.
    """
    text = lambda names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns], F.lit(""))
    return _placed(df, [text(video), text(question)])


def in_image_order(df: DataFrame, image: str = "image_path", expression: str = "expression") -> DataFrame:
    """Samples by image, then referring expression, with their ``place`` from 0 (Q7); missing values come first."""
    return _placed(df, [F.coalesce(F.col(c), F.lit("")) for c in (image, expression)])


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(names, order, strict=True)))
    return global_rank(keyed, names).withColumnRenamed("rank", "place").drop(*names).orderBy("place")


# Instructions that prompts end with.
NUMBER_ONLY = "Output only a number. Do not output option letters, units, explanations, or punctuation."
LETTER_ONLY = "Answer with the option letter only."
LOOSE = r"(?i)\s*Please answer the question using a single word or phrase\.?\s*"


def strict_prompt(prompt: Column, kind: Column) -> Column:
    """A prompt that asks for a bare number or letter (X15); applied twice it changes nothing more."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    bare = strip(F.coalesce(prompt, F.lit("")))
    numeric = F.lit(False)
    for k, m in SPACE_REPORT:
        if m == "MRA":
            numeric = numeric | kind.startswith(k)
    ask = F.concat(strip(F.regexp_replace(bare, LOOSE, "\n")), F.lit("\n" + NUMBER_ONLY))
    has_letter = F.lower(bare).contains("option") & F.lower(bare).contains("letter")
    choice = kind.startswith("object_rel") | (kind == "route_planning") | (kind == "obj_appearance_order")
    return (
        F.when(numeric, F.when(F.contains(bare, F.lit(NUMBER_ONLY)), bare).otherwise(ask))
        .when(choice, F.when(has_letter, bare).otherwise(F.concat(F.rtrim(bare), F.lit("\n" + LETTER_ONLY))))
        .otherwise(bare)
    )


def choice_prompt(question: Column, options: Column, tail: str) -> Column:
    """Question, lettered options and a closing instruction."""
    lettered = F.transform(options, lambda o, i: F.concat(F.substring(F.lit("ABCDEFGHIJ"), i + 1, F.lit(1)), F.lit(". "), o))
    return F.concat_ws("\n", F.trim(question), F.array_join(lettered, "\n"), F.lit(tail))


def align_placeholders(prompt: Column, count: Column, marker: str = "<video>") -> Column:
    """A prompt with as many markers as media (X16): later ones are taken out, too few are an error."""
    parts = F.split(prompt, marker)
    found = F.size(parts) - 1
    head = F.array_join(F.slice(parts, F.lit(1), count + 1), marker)
    rest = F.array_join(F.slice(parts, count + 2, F.greatest(F.size(parts), F.lit(1))), "")
    short = F.raise_error(F.concat(F.lit("a prompt has fewer media markers than media: "), prompt)).cast("string")
    return F.when(found < count, short).otherwise(F.concat(head, rest))


def back_fill(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Fill columns from their aliases where they are null or absent (X18); what is there stays."""
    out = df
    for name, others in aliases.items():
        present = [F.col(c) for c in [name, *others] if c in df.columns]
        if present:
            out = out.withColumn(name, F.coalesce(*present))
    return out


def flatten_metrics(df: DataFrame, metrics: str = "metrics") -> DataFrame:
    """A nested map of metrics as rows of slash-joined names."""
    return df.select(F.explode(metrics).alias("section", "inner")).select("section", F.explode("inner").alias("name", "value")).select(F.concat_ws("/", "section", "name").alias("metric"), "value")


def nest_metrics(df: DataFrame) -> DataFrame:
    """The inverse: one row a section with a map of its metrics."""
    parts = F.split("metric", "/", 2)
    named = df.select(F.get(parts, F.lit(0)).alias("section"), F.get(parts, F.lit(1)).alias("name"), "value")
    return named.groupBy("section").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("metrics"))
