"""Validation suites over manifests: every broken rule as a row (suite, rule, severity, key, detail).

Tables are DataFrames; files are tables (path, size, sha256) from a listing, so that a suite is one plan without access to
paths. A missing value is a blank. ``validation.require`` makes a gate that raises of any suite.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import scalars as S

from .graph import star_edges
from .validation import annotation_rules, first_failure, violations

ERROR = "error"


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def _without(rows: DataFrame, others: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """The distinct keys of ``rows`` that ``others`` lacks."""
    return rows.select(key).distinct().join(others.select(F.col(other or key).alias(key)), key, "left_anti")


def _both(rows: DataFrame, others: DataFrame, key: str, other: str | None = None) -> DataFrame:
    return rows.select(key).distinct().join(others.select(F.col(other or key).alias(key)), key, "left_semi")


def _rule(rule: str | Column, rows: DataFrame, key: str | Column, detail: str | Column = "") -> tuple:
    return rule, ERROR, rows, F.col(key) if isinstance(key, str) else key, F.lit(detail) if isinstance(detail, str) else detail


def dataset_files(images: DataFrame, labels: DataFrame, lines: DataFrame, classes: int, extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".bmp", ".webp")) -> DataFrame:
    """All thirteen codes of ``images(path, readable)``, ``labels(path)`` and ``lines(path, line_number, line)``, every line of a label file.

    A line has the first code it breaks. An image without a valid line has no_valid_objects besides, unless it can't be used
    for another reason. Images match labels by the path without suffix and with ``labels`` for ``images``.
    """
    extension = F.lower(S.suffix(F.col("path")))
    known = images.withColumns({"supported": extension.isin(*extensions), "label": F.regexp_replace("path", r"^(.*/)?images/(.*?)(\.[^./]*)?$", "$1labels/$2.txt"), "stem": F.lower(S.stem(F.col("path")))})
    good = known.where("supported")
    judged = lines.where(F.trim("line") != "").select("path", "line_number", first_failure(annotation_rules(S.tokens(F.col("line")), classes)).alias("code"))
    full = lines.where(F.trim("line") != "").select("path").distinct()
    valid = judged.where("code IS NULL").select(F.col("path").alias("label")).distinct()
    with_label = good.where("readable").join(labels.select(F.col("path").alias("label")).distinct(), "label", "left_semi")
    return violations("dataset", [
        _rule("unsupported_image_extension", known.where("NOT supported"), "path"),
        _rule("orphan_label", _without(labels, good, "path", "label"), "path"),
        _rule("corrupt_image", good.where("NOT readable"), "path"),
        _rule("missing_label", good.join(labels.select(F.col("path").alias("label")), "label", "left_anti"), "path"),
        _rule("empty_label", labels.select("path").distinct().join(full, "path", "left_anti"), "path"),
        _rule(F.col("code"), judged.where("code IS NOT NULL"), F.concat_ws(":", "path", "line_number")),  # all codes of lines in one pass
        _rule("no_valid_objects", with_label.join(valid, "label", "left_anti"), "path"),
        _rule("duplicate_file_stem", good.join(_repeated(good, "stem"), "stem", "left_semi"), "path"),
    ])


def included_images(images: DataFrame, found: DataFrame) -> DataFrame:
    """``images(path)`` with inclusion_status and exclusion_reason: excluded if a violation of ``dataset_files`` names it or its label."""
    label = F.regexp_replace("path", r"^(.*/)?images/(.*?)(\.[^./]*)?$", "$1labels/$2.txt")
    own = found.select(F.regexp_replace("key", r":[0-9]+$", "").alias("at"), "rule")
    reasons = images.select("path", F.explode(F.array(F.col("path"), label)).alias("at")).join(own, "at").groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("rule")), ";").alias("exclusion_reason"))
    out = images.join(reasons, "path", "left").withColumn("exclusion_reason", F.coalesce("exclusion_reason", F.lit("")))
    return out.withColumn("inclusion_status", F.when(F.col("exclusion_reason") == "", "included").otherwise("excluded"))


def review_integrity(records: DataFrame, duplicates: DataFrame, sources: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``records(image_path, inclusion_status)``, ``duplicates(image_path, duplicate_group_id, review_status)``,
    ``sources(image_path, source_group_id, review_status)``, ``files(path)``."""
    included, excluded = records.where("inclusion_status = 'included'"), records.where("coalesce(inclusion_status, '') <> 'included'")
    d = duplicates.select("image_path", _blank("duplicate_group_id").alias("group"), _blank("review_status").alias("status"))
    s = sources.select("image_path", _blank("source_group_id").alias("source"), _blank("review_status").alias("status"))
    confirmed = d.where("status = 'confirmed' AND group <> ''")
    of = confirmed.join(s.select("image_path", "source"), "image_path", "left").groupBy("group")
    mixed = of.agg(F.countDistinct(F.coalesce("source", F.lit(""))).alias("n"), F.max(F.coalesce("source", F.lit("")) == "").alias("none"))
    rules = [
        _rule("duplicate_pending", d.where("status = 'pending'"), "image_path"),
        _rule("duplicate_status_invalid", d.where("status NOT IN ('confirmed', 'rejected', 'not_applicable', 'pending')"), "image_path", F.col("status")),
        _rule("duplicate_assigned_twice", _repeated(d, "image_path"), "image_path"),
        _rule("duplicate_missing", _without(included, d, "image_path"), "image_path"),
        _rule("duplicate_extra", _without(d, included, "image_path"), "image_path"),
        _rule("confirmed_without_group", d.where("status = 'confirmed' AND group = ''"), "image_path"),
        _rule("group_kept_on_rejected", d.where("status IN ('rejected', 'not_applicable') AND group <> ''"), "image_path", F.col("group")),
        _rule("group_of_one", confirmed.groupBy("group").agg(F.count("*").alias("n")).where("n < 2"), "group"),
        _rule("source_pending", s.where("status IN ('pending', 'split_required', 'merge_required')"), "image_path", F.col("status")),
        _rule("source_status_invalid", s.where("status NOT IN ('confirmed', 'not_applicable', 'pending', 'split_required', 'merge_required')"), "image_path", F.col("status")),
        _rule("source_assigned_twice", _repeated(s, "image_path"), "image_path"),
        _rule("source_missing", _without(included, s, "image_path"), "image_path"),
        _rule("source_extra", _without(s, included, "image_path"), "image_path"),
        _rule("source_of_excluded", _both(s, excluded, "image_path"), "image_path"),
        _rule("source_without_id", s.where("source = ''"), "image_path"),
        _rule("group_across_sources", mixed.where("n <> 1 OR none"), "group"),
    ]
    if files is not None:
        rules.append(_rule("file_missing", _without(_both(s, included, "image_path"), files, "image_path", "path"), "image_path"))
    return violations("review", rules)


def split_preconditions(records: DataFrame, duplicates: DataFrame, sources: DataFrame | None, allow_unknown: bool = False) -> DataFrame:
    """What must hold before a split: reviewed groups, the very included images, a source of each (or the express waiver)."""
    included = records.where("inclusion_status = 'included'")
    rules = [
        _rule("nothing_included", included.agg(F.count("*").alias("n")).where("n = 0"), F.lit("records")),
        _rule("duplicate_rows_differ", _without(included, duplicates, "image_path").unionAll(_without(duplicates, included, "image_path")), "image_path"),
        _rule("duplicate_pending", duplicates.where((_blank("duplicate_group_id") != "") & (_blank("review_status") == "pending")).select("duplicate_group_id").distinct(), "duplicate_group_id"),
    ]
    if sources is not None:
        reviewed = _blank("review_status").isin("confirmed", "not_applicable")
        rules += [
            _rule("source_pending", sources.where(~reviewed).select("source_group_id").distinct(), "source_group_id"),
            _rule("source_missing", _without(included, sources.where(_blank("source_group_id") != ""), "image_path"), "image_path"),
        ]
    elif not allow_unknown:
        rules.append(_rule("no_sources_given", included.sparkSession.range(1), F.lit("sources")))
    return violations("split", rules)


def leakage(splits: DataFrame, duplicates: DataFrame, manifests: DataFrame, outputs: DataFrame, hashes: DataFrame | None = None, expected: str | None = None) -> DataFrame:
    """``splits(split, image_path, content_hash, source_group_id)``, ``duplicates(image_path, duplicate_group_id)``, the sources that a
    later table uses ``manifests(manifest, image_path, content_hash)``, the paths it writes ``outputs(path)``, and the frozen files
    ``hashes(name, expected, actual, combined)``, actual null where the file is missing. Blank values never overlap."""
    group = splits.join(duplicates.select("image_path", "duplicate_group_id"), "image_path")
    rules = []
    for name, rows, value in (("path", splits, "image_path"), ("hash", splits, "content_hash"), ("source", splits, "source_group_id"), ("duplicate_group", group, "duplicate_group_id")):
        own = rows.select("split", _blank(value).alias("value")).where("value <> ''").distinct()
        shared = own.groupBy("value").agg(F.array_join(F.array_sort(F.collect_list("split")), ",").alias("splits"), F.count("*").alias("n")).where("n > 1")
        rules.append(_rule(f"{name}_overlap", shared, "value", F.col("splits")))
    protected = splits.where("split IN ('val', 'test')")
    for name, value in (("path", "image_path"), ("hash", "content_hash")):
        held = protected.select(F.col("split"), _blank(value).alias("value")).where("value <> ''").distinct()
        used = manifests.select("manifest", _blank(value).alias("value")).distinct()
        rules.append(_rule(f"protected_{name}_used", held.join(used, "value"), "value", F.concat_ws(":", "split", "manifest")))
    train = splits.where("split = 'train'").select(F.col("image_path").alias("image_path"), F.col("content_hash").alias("_train"))
    traced = manifests.join(train, "image_path", "left")
    rules += [
        _rule("source_not_train", traced.where("_train IS NULL"), "image_path", F.col("manifest")),
        _rule("source_hash_differs", traced.where("_train <> content_hash"), "image_path", F.col("manifest")),
        _rule("output_is_a_real_path", _both(outputs, splits, "path", "image_path"), "path"),
    ]
    if hashes is not None:
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "actual"))), lambda x: F.concat(x["name"], F.lit(":"), x["actual"])), "\n")
        whole = hashes.agg(F.sha2(lines, 256).alias("identity"), F.max("combined").alias("combined"), F.count_if(F.col("actual").isNull()).alias("missing"))
        rules += [
            _rule("frozen_file_missing", hashes.where("actual IS NULL"), "name"),
            _rule("frozen_hash_differs", hashes.where("actual <> expected"), "name"),
            _rule("combined_identity_differs", whole.where("missing = 0 AND NOT identity <=> combined"), "identity"),
        ]
        if expected is not None:
            rules.append(_rule("expected_identity_differs", whole.where(~F.col("combined").eqNullSafe(F.lit(expected))), F.coalesce("combined", F.lit(""))))
    return violations("leakage", rules)


def object_bank(train: DataFrame, bank: DataFrame, excluded: DataFrame, files: DataFrame, classes: DataFrame) -> DataFrame:
    """``train(image_path, content_hash)``, ``bank(object_id, image_path, content_hash, class_name, inclusion_status, exclusion_reason,
    crop_path, mask_path, crop_hash, mask_hash)``, its ``excluded`` rows, ``files(path, sha256, width, height)``, ``classes(class_name)``."""
    used, out = bank.where("inclusion_status = 'included'"), bank.where("coalesce(inclusion_status, '') <> 'included'")
    columns = bank.columns
    unequal = out.select(*columns).exceptAll(excluded.select(*columns)).unionAll(excluded.select(*columns).exceptAll(out.select(*columns)))
    traced = bank.join(train.select("image_path", F.col("content_hash").alias("_train")), "image_path", "left")
    end = lambda x: files.select(F.col("path").alias(f"{x}_path"), F.col("sha256").alias(f"_{x}"), F.struct("width", "height").alias(f"_{x}_size"))
    pairs = used.join(end("crop"), "crop_path", "left").join(end("mask"), "mask_path", "left")
    there = pairs.where("_crop IS NOT NULL AND _mask IS NOT NULL")
    rules = [
        _rule("excluded_rows_differ", unequal, "object_id"),
        _rule("object_id_repeated", _repeated(bank, "object_id"), "object_id"),
        _rule("source_not_train", traced.where("_train IS NULL"), "object_id", F.col("image_path")),
        _rule("source_hash_differs", traced.where("_train <> content_hash"), "object_id", F.col("image_path")),
        _rule("excluded_without_reason", out.where(_blank("exclusion_reason") == ""), "object_id"),
        _rule("path_unsafe", used.where(S.unsafe_path(F.col("crop_path")) | S.unsafe_path(F.col("mask_path"))), "object_id"),
        _rule("crop_or_mask_missing", pairs.where("_crop IS NULL OR _mask IS NULL"), "object_id"),
        _rule("crop_or_mask_hash_differs", there.where("_crop <> crop_hash OR _mask <> mask_hash"), "object_id"),
        _rule("crop_and_mask_sizes_differ", there.where("NOT _crop_size <=> _mask_size"), "object_id"),
        _rule("class_without_object", _without(classes, used, "class_name"), "class_name"),
        _rule("class_unknown", _without(used, classes, "class_name"), "class_name"),
    ]
    return violations("object_bank", rules)


def synthetic_pool(images: DataFrame, sources: DataFrame, backgrounds: DataFrame, bank: DataFrame, splits: DataFrame, files: DataFrame, lines: DataFrame, base_lines: DataFrame, classes: int, expected: int, identity: str) -> DataFrame:
    """The rows and tables of a generated pool against their provenance.

    ``images(image_path, label_path, image_hash, label_hash, total, pasted, retained, width, height, identity)``, one row of ``backgrounds
    (image, image_path, content_hash, label_path)`` each, ``sources(image, object_id, image_path, content_hash)`` one per pasted object,
    ``bank(object_id, image_path, content_hash, inclusion_status)``, ``splits(split, image_path, content_hash)``, ``files(path, sha256,
    width, height)``, and ``lines(path, line_number, line)`` of the pool's labels and of the ``base_lines`` they begin with.
    """
    train = splits.where("split = 'train'").select("image_path", F.col("content_hash").alias("_train"))
    protected = splits.where("split IN ('val', 'test')")
    path_at = lambda c, name: files.select(F.col("path").alias(c), F.col("sha256").alias(f"_{name}"), F.col("width").alias(f"_{name}_w"), F.col("height").alias(f"_{name}_h"))
    found = images.join(path_at("image_path", "image"), "image_path", "left").join(path_at("label_path", "label"), "label_path", "left")
    there = found.where("_image IS NOT NULL AND _label IS NOT NULL")
    own_lines = lines.join(there.select(F.col("label_path").alias("path"), "image_path"), "path")
    n_lines = there.join(own_lines.groupBy("image_path").agg(F.count("*").alias("n")), "image_path", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    n_sources = images.join(sources.groupBy(F.col("image").alias("image_path")).agg(F.count("*").alias("n")), "image_path", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    judged = own_lines.select("image_path", "path", "line_number", first_failure(annotation_rules(S.tokens(F.col("line")), classes)).alias("code"), S.tokens(F.col("line")).alias("t"))
    seen = judged.where("code IS NULL OR code = 'box_outside_image'").select(S.number(F.get("t", 0)).cast("int").alias("class")).distinct()
    b = backgrounds.join(train, "image_path", "left").join(protected.select("image_path", F.lit(True).alias("_held")).distinct(), "image_path", "left")
    not_train = F.col("_train").isNull() | F.coalesce("_held", F.lit(False))
    usable = bank.where("inclusion_status = 'included'").select("object_id", F.col("image_path").alias("_path"), F.col("content_hash").alias("_hash"))
    s = sources.join(usable, "object_id", "left")
    s_known = s.where("_path IS NOT NULL").join(train, "image_path", "left").join(protected.select("image_path", F.lit(True).alias("_held")).distinct(), "image_path", "left")
    base = backgrounds.select(F.col("image").alias("image_path"), F.col("label_path").alias("path")).join(base_lines, "path").select("image_path", "line_number", S.tokens(F.col("line")).alias("old"))
    n_base = images.join(base.groupBy("image_path").agg(F.count("*").alias("n")), "image_path", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    kept = base.join(own_lines.select("image_path", "line_number", S.tokens(F.col("line")).alias("new")), ["image_path", "line_number"], "left")
    apart = F.exists(F.zip_with("old", "new", lambda x, y: ~S.close(S.number(x), S.number(y), 1e-9)), lambda v: F.coalesce(v, F.lit(True)))
    names = lambda c: F.lower(S.stem(F.col(c)))
    return violations("synthetic_pool", [
        _rule("image_count", images.agg(F.count("*").alias("n")).where(F.col("n") != expected), F.lit("images"), F.col("n").cast("string")),
        _rule("image_path_repeated", _repeated(images, "image_path"), "image_path"),
        _rule("background_count", backgrounds.agg(F.count("*").alias("n")).join(images.agg(F.count("*").alias("m")), F.lit(True)).where("n <> m"), F.lit("backgrounds")),
        _rule("path_unsafe", images.where(S.unsafe_path(F.col("image_path")) | S.unsafe_path(F.col("label_path"))), "image_path"),
        _rule("pair_missing", found.where("_image IS NULL OR _label IS NULL"), "image_path"),
        _rule("stem_differs", images.where(names("image_path") != names("label_path")), "image_path"),
        _rule("image_hash_differs", there.where("_image <> image_hash"), "image_path"),
        _rule("label_hash_differs", there.where("_label <> label_hash"), "label_path"),
        _rule("label_count_differs", n_lines.where("n <> total"), "label_path"),
        _rule("nothing_pasted", images.where("pasted < 1"), "image_path"),
        _rule("source_count_differs", n_sources.where("n <> pasted"), "image_path"),
        _rule("line_invalid", judged.where("code IS NOT NULL AND code <> 'box_outside_image'"), F.concat_ws(":", "path", "line_number"), F.col("code")),
        _rule("background_missing", _without(images, backgrounds, "image_path", "image"), "image_path"),
        _rule("background_not_train", b.where(not_train), "image"),
        _rule("background_hash_differs", b.where(~not_train & (F.col("_train") != F.col("content_hash"))), "image"),
        _rule("base_count_differs", n_base.where("n <> retained"), "image_path"),
        _rule("base_line_changed", kept.where(F.col("new").isNull() | apart).select("image_path").distinct(), "image_path"),
        _rule("dimensions_differ", there.where("width <> _image_w OR height <> _image_h"), "image_path"),
        _rule("split_identity_differs", images.where(~F.col("identity").eqNullSafe(F.lit(identity))), "image_path"),
        _rule("object_not_in_bank", s.where("_path IS NULL"), "object_id"),
        _rule("object_provenance_differs", s.where("image_path <> _path OR content_hash <> _hash"), "object_id"),
        _rule("object_not_train", s_known.where(not_train), "object_id"),
        _rule("protected_hash_used", sources.join(protected.select("content_hash").distinct(), "content_hash", "left_semi"), "object_id"),
        _rule("class_missing", images.sparkSession.range(classes).select(F.col("id").cast("int").alias("class")).join(seen, "class", "left_anti"), "class"),
        _rule("image_repeated", _repeated(images, "image_hash"), "image_hash"),
        _rule("image_is_real", _both(images, splits, "image_hash", "content_hash"), "image_hash"),
    ])


def provenance(rows: DataFrame, real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """``rows(sample_type, image_path)`` with ``source_hash``: real rows look in one table (path, hash), all others in the other."""
    out = rows.join(real.select(F.col("path").alias("image_path"), F.col("hash").alias("_real")), "image_path", "left")
    out = out.join(synthetic.select(F.col("path").alias("image_path"), F.col("hash").alias("_synthetic")), "image_path", "left")
    return out.withColumn("source_hash", F.when(F.col("sample_type") == "real", F.col("_real")).otherwise(F.col("_synthetic"))).drop("_real", "_synthetic")


def regimes(rows: DataFrame, counts: DataFrame, real: DataFrame, synthetic: DataFrame, protected: DataFrame, identities: tuple[str, str]) -> DataFrame:
    """``rows(regime, sample_type, image_path, canvas, image_hash, real_identity, pool_identity)`` against ``counts(regime, real, synthetic)``,
    ``real(path, hash)``, ``synthetic(path, hash)`` and ``protected(path, hash)``."""
    has = rows.groupBy("regime").agg(F.count_if(F.col("sample_type") == "real").alias("has_real"), F.count_if(F.col("sample_type") == "synthetic").alias("has_synthetic"), F.count("*").alias("n"))
    has = counts.join(has, "regime", "left").na.fill(0, ["has_real", "has_synthetic", "n"])
    grid = counts.select("regime").join(real.select(F.col("path").alias("canvas")).distinct(), F.lit(True))
    traced = provenance(rows, real, synthetic)
    key = F.concat_ws(":", "regime", "image_path")
    held = rows.join(protected.select(F.col("path").alias("image_path")).distinct(), "image_path", "left_semi").unionByName(rows.join(protected.select(F.col("hash").alias("image_hash")).distinct(), "image_hash", "left_semi")).distinct()
    return violations("regimes", [
        _rule("row_count", has.where("n <> real + synthetic"), "regime", F.col("n").cast("string")),
        _rule("real_count", has.where("has_real <> real"), "regime"),
        _rule("synthetic_count", has.where("has_synthetic <> synthetic"), "regime"),
        _rule("canvas_repeated", rows.groupBy("regime", "canvas").agg(F.count("*").alias("n")).where("n > 1"), F.concat_ws(":", "regime", "canvas")),
        _rule("canvas_missing", grid.join(rows, ["regime", "canvas"], "left_anti"), F.concat_ws(":", "regime", "canvas")),
        _rule("canvas_unknown", rows.join(real.select(F.col("path").alias("canvas")), "canvas", "left_anti").select("regime", "canvas").distinct(), F.concat_ws(":", "regime", "canvas")),
        _rule("protected_used", held, key),
        _rule("real_identity_differs", rows.where(~F.col("real_identity").eqNullSafe(F.lit(identities[0]))), key),
        _rule("pool_identity_differs", rows.where(~F.col("pool_identity").eqNullSafe(F.lit(identities[1]))), key),
        _rule("path_unknown", traced.where("source_hash IS NULL"), key),
        _rule("image_hash_differs", traced.where("source_hash <> image_hash"), key),
    ])


def views(files: DataFrame, lines: DataFrame, names: DataFrame, regimes_: DataFrame, class_names: list[str], validation: DataFrame, n_train: int, n_val: int) -> DataFrame:
    """``files(regime, split, kind, path, sha256)`` of kind image or label, their ``lines(regime, path, line_number, line)``, ``names(regime,
    position, class_name)`` and the ``validation(sha256)`` images that every one of ``regimes_(regime)`` must have."""
    want = regimes_.join(files.sparkSession.createDataFrame([("train", n_train), ("val", n_val)], "split string, want int"), F.lit(True))
    counts = files.groupBy("regime", "split").agg(F.count_if(F.col("kind") == "image").alias("images"), F.count_if(F.col("kind") == "label").alias("labels"))
    counts = want.join(counts, ["regime", "split"], "left").na.fill(0, ["images", "labels"])
    stems = files.groupBy("regime", "split", S.stem(F.col("path")).alias("stem")).agg(F.count_if(F.col("kind") == "image").alias("i"), F.count_if(F.col("kind") == "label").alias("l"))
    order = names.groupBy("regime").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "class_name"))), lambda x: x["class_name"]).alias("names"))
    order = regimes_.join(order, "regime", "left")
    fields = S.tokens(F.col("line"))
    v = [S.number(F.get(fields, i)) for i in range(5)]
    class_ = F.when(F.get(fields, 0).rlike(r"^[+-]?[0-9]+$"), v[0])
    numeric = reduce(lambda a, b: a & b, [x.isNotNull() for x in [class_, *v[1:]]])
    five = F.size(fields) == 5
    at = F.concat_ws(":", "regime", "path", "line_number")
    own = files.where("split = 'val' AND kind = 'image'").select("regime", "sha256").distinct()
    must = regimes_.join(validation.select("sha256").distinct(), F.lit(True))
    return violations("views", [
        _rule("class_order", order.where(~F.col("names").eqNullSafe(F.array(*[F.lit(x) for x in class_names]))), "regime"),
        _rule("pair_count", counts.where("images <> want OR labels <> want"), F.concat_ws(":", "regime", "split")),
        _rule("stems_differ", stems.where("(i = 0) <> (l = 0)").select("regime", "split").distinct(), F.concat_ws(":", "regime", "split")),
        _rule("field_count", lines.where(~five), at),
        _rule("non_numeric", lines.where(five & ~numeric), at),
        _rule("class_invalid", lines.where(five & numeric & ~class_.between(0, len(class_names) - 1)), at),
        _rule("box_invalid", lines.where(five & numeric & ((F.least(*v[1:]) < 0) | (F.greatest(*v[1:]) > 1) | (v[3] <= 0) | (v[4] <= 0))), at),
        _rule("validation_differs", own.join(must, ["regime", "sha256"], "left_anti").unionByName(must.join(own, ["regime", "sha256"], "left_anti")).select("regime").distinct(), "regime"),
    ])


def run_log(rows: DataFrame, run: str, epoch: str, columns: list[str]) -> DataFrame:
    """A log of numbers by epoch as text: empty, non-numeric or non-finite, repeated and missing epochs."""
    bad = F.filter(F.array(*[F.when(S.number(F.col(f"`{c}`")).isNull(), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    e = S.number(F.col(f"`{epoch}`"))
    by = rows.select(run, e.alias("e")).groupBy(run).agg(F.count("e").alias("n"), F.countDistinct("e").alias("d"), F.min("e").alias("lo"), F.max("e").alias("hi"))
    return violations("run_log", [
        _rule("non_numeric", rows.where(F.size(bad) > 0), F.concat_ws(":", F.col(run), F.col(f"`{epoch}`")), F.array_join(bad, ",")),
        _rule("epoch_repeated", by.where("n <> d"), run),
        _rule("epoch_missing", by.where("hi - lo + 1 <> d"), run),
    ])


def archive(inventory: DataFrame, members: DataFrame, allowed_plots: tuple[str, ...] = ()) -> DataFrame:
    """``inventory(path, size, sha256)`` against ``members(path, size, sha256, is_dir, is_link, text)``, text of small text members."""
    both = inventory.alias("i").join(members.alias("m"), F.col("i.path") == F.col("m.path"), "full").select(F.coalesce("i.path", "m.path").alias("path"), F.col("i.path").isNull().alias("extra"), F.col("m.path").isNull().alias("missing"), (F.col("i.size") != F.col("m.size")).alias("size"), (F.col("i.sha256") != F.col("m.sha256")).alias("hash"))
    end = F.lower(S.suffix(F.col("path")))
    secret = reduce(lambda a, b: a | b, [F.col("text").rlike(x) for x in S.SECRETS.values()])
    image = end.isin(".jpg", ".jpeg", ".bmp", ".webp", ".gif", ".tiff") | ((end == ".png") & ~F.coalesce(F.lower(F.element_at(F.split("path", "/"), -1)).isin("", *allowed_plots), F.lit(False)))
    return violations("archive", [
        _rule("member_missing", both.where("missing"), "path"), _rule("member_unlisted", both.where("extra"), "path"),
        _rule("member_size_differs", both.where("size"), "path"), _rule("member_hash_differs", both.where("hash"), "path"),
        _rule("member_repeated", _repeated(members, "path"), "path"), _rule("inventory_repeated", _repeated(inventory, "path"), "path"),
        _rule("path_unsafe", members.where(S.unsafe_path(F.col("path"))), "path"), _rule("content_prohibited", members.where(S.prohibited(F.col("path"))), "path"),
        _rule("image_prohibited", members.where(image), "path"), _rule("directory", members.where("is_dir"), "path"), _rule("link", members.where("is_link"), "path"),
        _rule("secret", members.where(F.coalesce(secret, F.lit(False))), "path"), _rule("digest_invalid", inventory.where(~S.is_digest(F.col("sha256"))), "path"),
    ])


def config_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Keys of ``expected(key, value)`` whose value in ``actual(key, value)`` is another or absent, as violations."""
    both = expected.join(actual.select("key", F.col("value").alias("found")), "key", "left")
    return violations("config", [_rule("value_differs", both.where("NOT value <=> found"), "key", F.concat_ws(" for ", F.coalesce("found", F.lit("nothing")), "value"))])


def completed_runs(runs: DataFrame, files: DataFrame, required: tuple[str, ...], epochs: int) -> DataFrame:
    """``runs(run, status, mode, profile, epochs, test_access)`` and their ``files(run, name)``: finished, final, whole, never near the test split."""
    need = runs.select("run", F.explode(F.array(*[F.lit(x) for x in required])).alias("name"))
    several = runs.agg(F.countDistinct("profile").alias("n")).where("n > 1")
    return violations("runs", [
        _rule("not_completed", runs.where("NOT status <=> 'completed'"), "run", F.coalesce("status", F.lit(""))), _rule("not_final", runs.where("NOT mode <=> 'final'"), "run"),
        _rule("epochs", runs.where(~F.col("epochs").eqNullSafe(F.lit(epochs))), "run"), _rule("test_access", runs.where("coalesce(test_access, 1) <> 0"), "run"),
        _rule("file_missing", need.join(files, ["run", "name"], "left_anti"), F.concat_ws("/", "run", "name")), _rule("profiles_differ", several, F.lit("profile")),
    ])


def split_files(rows: DataFrame, files: DataFrame, status: str = "included") -> DataFrame:
    """``rows(image_path, label_path, inclusion_status, content_hash, width, height, objects)`` of one split against ``files(path, sha256, width,
    height, lines)``."""
    end = lambda c, x: files.select(F.col("path").alias(c), F.col("sha256").alias(f"_{x}"), F.col("width").alias(f"_{x}_w"), F.col("height").alias(f"_{x}_h"), F.col("lines").alias(f"_{x}_n"))
    found = rows.join(end("image_path", "i"), "image_path", "left").join(end("label_path", "l"), "label_path", "left")
    return violations("split_files", [
        _rule("status", rows.where(~F.col("inclusion_status").eqNullSafe(F.lit(status))), "image_path"), _rule("path_repeated", _repeated(rows, "image_path"), "image_path"),
        _rule("hash_repeated", _repeated(rows, "content_hash"), "content_hash"), _rule("file_missing", found.where("_i IS NULL OR _l IS NULL"), "image_path"),
        _rule("hash_differs", found.where("_i <> content_hash"), "image_path"), _rule("size_differs", found.where("width <> _i_w OR height <> _i_h"), "image_path"),
        _rule("object_count_differs", found.where("objects <> _l_n"), "image_path"),
    ])


def campaign(results: DataFrame, order: list[str], lock: DataFrame, files: DataFrame) -> DataFrame:
    """A sealed result: ``results(place, model, map, map50, latency, place_in_ranking)``, ``lock(name, sha256)`` and the ``files(name, sha256)``."""
    w = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "model"))), lambda x: x["model"]), ",")
    better = results.alias("a").join(results.select("model", "map", "map50", "latency", "place").alias("b"), F.lit(True)).where("struct(-b.map, -b.map50, b.latency, b.place) < struct(-a.map, -a.map50, a.latency, a.place)")
    rank = results.join(better.groupBy("a.model").agg(F.count("*").alias("n")), "model", "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    both = lock.join(files.select("name", F.col("sha256").alias("found")), "name", "left")
    return violations("campaign", [
        _rule("model_order", results.agg(w.alias("found")).where(F.col("found") != ",".join(order)), "found"), _rule("file_missing", both.where("found IS NULL"), "name"),
        _rule("file_hash_differs", both.where("found <> sha256"), "name"), _rule("ranking_differs", rank.where("n <> place_in_ranking"), "model", F.col("n").cast("string")),
    ])


def text_policy(cells: DataFrame, sections: list[str], banned: tuple[str, ...]) -> DataFrame:
    """``cells(position, text)``: the ordered ``sections`` must head cells in their order, and no banned string occurs."""
    heads = cells.where(F.trim("text").isin(*sections)).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.trim("text").alias("text")))), lambda x: x["text"]).alias("found"))
    rules = [_rule("section_order", heads.where(~F.col("found").eqNullSafe(F.array(*[F.lit(x) for x in sections]))), F.array_join("found", ","))]
    rules += [_rule("banned_text", cells.where(F.contains("text", F.lit(x))), F.col("position").cast("string"), x) for x in banned]
    return violations("text", rules)


def snapshot_policy(document: DataFrame, counts: dict[str, int], banned: tuple[str, ...]) -> DataFrame:
    """One JSON ``document``: its arrays have the given lengths and no forbidden string occurs."""
    length = lambda k: F.size(F.from_json(F.get_json_object("document", f"$.{k}"), "array<string>"))
    rules = [_rule("count", document.where(~F.coalesce(length(k) == n, F.lit(False))), F.lit(k), F.coalesce(length(k).cast("string"), F.lit("absent"))) for k, n in counts.items()]
    return violations("snapshot", rules + [_rule("forbidden", document.where(S.contains_any(F.col("document"), (x,))), F.lit(x)) for x in banned])


def settings(values: DataFrame, schema: DataFrame) -> DataFrame:
    """``values(key, value)`` as text against ``schema(key, kind, low, high, below)``: known, present, of its kind, in range, and under key ``below``."""
    n = S.number(F.col("value"))
    own = values.join(schema, "key").withColumn("n", n)
    wrong = F.when(F.col("kind") == "int", n.isNull() | (n != F.floor(n))).when(F.col("kind") == "double", n.isNull()).when(F.col("kind") == "boolean", ~F.lower("value").isin("true", "false")).otherwise(F.col("value").isNull() | (F.trim("value") == ""))
    upper = own.alias("a").join(own.select(F.col("key").alias("below"), F.col("n").alias("_upper")).alias("b"), "below")
    return violations("settings", [
        _rule("key_unknown", _without(values, schema, "key"), "key"), _rule("key_missing", _without(schema, values, "key"), "key"), _rule("key_repeated", _repeated(values, "key"), "key"),
        _rule("kind", own.where(F.coalesce(wrong, F.lit(True))), "key", F.col("kind")), _rule("range", own.where("n < low OR n > high"), "key"), _rule("order", upper.where("n >= _upper"), "key"),
    ])


def smoke_runs(latest: DataFrame, expected: DataFrame, files: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """The ``latest(regime, run, status, smoke, test_access)`` run of every ``expected(regime)`` has its ``files(run, name)`` and flags."""
    need = latest.select("run", F.explode(F.array(*[F.lit(x) for x in required])).alias("name"))
    return violations("smoke", [
        _rule("regime_missing", _without(expected, latest, "regime"), "regime"), _rule("not_completed", latest.where("NOT status <=> 'completed'"), "run"), _rule("not_smoke", latest.where("NOT coalesce(smoke, false)"), "run"),
        _rule("test_access", latest.where("coalesce(test_access, 1) <> 0"), "run"), _rule("file_missing", need.join(files, ["run", "name"], "left_anti"), F.concat_ws("/", "run", "name")),
    ])


def runner_inputs(rows: DataFrame, counts: DataFrame, files: DataFrame, frozen: DataFrame, test: DataFrame) -> DataFrame:
    """``rows(regime, split, path, identity)`` that a run reads: ``counts(regime, split, n)``, existing ``files(path)``, ``frozen(identity)`` ones, and no row of ``test(path)``."""
    has = counts.join(rows.groupBy("regime", "split").agg(F.count("*").alias("has")), ["regime", "split"], "left")
    key = F.concat_ws(":", "regime", "path")
    return violations("inputs", [
        _rule("count", has.where("coalesce(has, 0) <> n"), F.concat_ws(":", "regime", "split")), _rule("path_unsafe", rows.where(S.unsafe_path(F.col("path"))), key), _rule("file_missing", _without(rows, files, "path"), "path"),
        _rule("identity_not_frozen", _without(rows, frozen, "identity"), "identity"), _rule("test_referenced", rows.join(test.select("path").distinct(), "path", "left_semi"), key),
    ])


def bundle(manifest: DataFrame, files: DataFrame, identity: str) -> DataFrame:
    """``manifest(path, sha256)`` against ``files(path, sha256)``: safe, allowed, equal on both sides, and of the given combined identity."""
    both = manifest.join(files.select("path", F.col("sha256").alias("found")), "path", "full")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat(x["path"], F.lit(":"), x["sha256"])), "\n")
    return violations("bundle", [
        _rule("file_missing", both.where("found IS NULL"), "path"), _rule("file_unlisted", both.where("sha256 IS NULL"), "path"), _rule("hash_differs", both.where("found <> sha256"), "path"),
        _rule("path_unsafe", manifest.where(S.unsafe_path(F.col("path"))), "path"), _rule("content_prohibited", manifest.where(S.prohibited(F.col("path"))), "path"),
        _rule("identity_differs", manifest.agg(F.sha2(lines, 256).alias("identity")).where(F.col("identity") != identity), "identity"),
    ])


def source_edges(rows: DataFrame) -> DataFrame:
    """Edges (a, b) of ``rows(path, duplicate_group_id)`` by three kinds of evidence: frames of one video, consecutive numbers of
    stills, and one duplicate group. Every relation is a star or a chain, so edges grow with the rows."""
    named = rows.withColumn("id", S.capture_id(F.col("path")))
    named = named.withColumns({"video": F.regexp_extract("id", r"^(IMG_[0-9]+_MOV)-[0-9]+$", 1), "no": F.regexp_extract("id", r"^IMG_([0-9]+)$", 1).try_cast("long")})
    stills = named.where("no IS NOT NULL")
    first = stills.groupBy("no").agg(F.min("path").alias("b"))
    same = stills.join(first, "no").where("path <> b").select(F.col("path").alias("a"), "b")
    after = first.join(first.select((F.col("no") + 1).alias("no"), F.col("b").alias("before")), "no").select(F.col("b").alias("a"), F.col("before").alias("b"))
    return star_edges(named, "path", "video").unionByName(star_edges(named, "path", "duplicate_group_id")).unionByName(after).unionByName(same)


def group_decisions(members: DataFrame) -> DataFrame:
    """``members(path, component, duplicate_group_id)`` to (component, size, status, evidence, action) of each group."""
    named = members.withColumn("id", S.capture_id(F.col("path"))).withColumn("video", F.regexp_extract("id", r"^(IMG_[0-9]+_MOV)-[0-9]+$", 1))
    out = named.groupBy("component").agg(F.count("*").alias("size"), F.min(F.col("video") != "").alias("all_video"), F.countDistinct("video").alias("videos"), F.array_join(F.array_sort(F.collect_set(F.nullif(_blank("duplicate_group_id"), F.lit("")))), ";").alias("duplicates"))
    video, several = F.col("all_video") & (F.col("videos") == 1), F.col("size") > 1
    evidence = F.when(video, "frames of one video file").when(several, F.concat(F.lit("consecutive capture numbers"), F.when(F.col("duplicates") != "", F.concat(F.lit("; near copies "), F.col("duplicates"))).otherwise(""))).otherwise("no evidence, a group of its own")
    action = F.when(video, "keep together").when(several, "look at the contact sheet, then confirm or split").otherwise("confirm, or merge with a reviewed group")
    return out.select("component", "size", F.when(video, "confirmed").otherwise("pending").alias("status"), evidence.alias("evidence"), action.alias("action"))
