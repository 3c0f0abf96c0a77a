"""Readers of survey layouts, and the canonical epochs table ``source_id, band, t, mag, emag, ord``."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.config import ZERO_POINT, ZERO_POINT_ERROR
from lumenfold.sources import ecsv

_POINT = "t double, mag double, emag double"


def read_ogle(spark: SparkSession, root: str, bands: tuple[str, ...] = ("V", "I")) -> DataFrame:
    """Headerless ``{root}/{catalogue}/{band}/{source}.dat`` files; other bands are left out, absent files are no rows."""
    rows = spark.read.schema(_POINT).option("sep", " ").csv(f"{root}/*/*/*.dat").withColumn("path", F.input_file_name())
    part = lambda i: F.regexp_extract("path", r"([^/]+)/([^/]+)\.dat$", i)
    return rows.select(part(2).alias("source_id"), part(1).alias("band"), "t", "mag", "emag", F.xxhash64("t", "mag", "emag").alias("ord")).where(F.col("band").isin(*bands))


def read_ogle_ident(spark: SparkSession, paths: list[str], widths: list[tuple[str, int, int]]) -> DataFrame:
    """Fixed-width identifier files: (column, start from 1, length); the catalogue is the file's stem without ``_ident``."""
    text = spark.read.text(paths).withColumn("path", F.input_file_name())
    catalogue = F.regexp_replace(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1), "_ident$", "")
    return text.select(*(F.nullif(F.trim(F.substring("value", a, n)), F.lit("")).alias(c) for c, a, n in widths), catalogue.alias("catalogue"))


#: points of a bucket of light curves
BUCKET = 5_000_000


def write_fitlc(epochs: DataFrame, path: str, bands: tuple[str, ...], bucket: int = BUCKET) -> None:
    """Light curves of all sources in files of about ``bucket`` points, with an index: no file or folder for each source.

    ``{path}/curves/bucket=N`` has lines ``source_id<tab>band t mag emag``, a source's together and by time;
    ``{path}/index`` has ``source_id, bucket, points``. ``curve_file`` writes one source's own file where a
    fitter needs it.
    """
    rows = epochs.where(F.col("band").isin(*bands))
    buckets = rows.count() // bucket + 1
    number = F.array_position(F.array(*map(F.lit, bands)), F.col("band")).cast("int") - 1
    line = F.format_string("%d %.8f %.6f %.6f", number, "t", "mag", "emag")
    rows = rows.select(F.col("source_id").cast("string").alias("source_id"), "t", line.alias("line")).withColumn("bucket", F.pmod(F.xxhash64("source_id"), F.lit(buckets)).cast("int"))
    lines = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "source_id", "t", "line").select("bucket", F.concat_ws("\t", "source_id", "line").alias("value"))
    lines.write.mode("overwrite").partitionBy("bucket").option("maxRecordsPerFile", 4 * bucket).text(f"{path}/curves")
    rows.groupBy("source_id", "bucket").agg(F.count("*").alias("points")).write.mode("overwrite").parquet(f"{path}/index")


def read_fitlc(spark: SparkSession, path: str, bands: tuple[str, ...], sources: list[str] | None = None) -> DataFrame:
    """Light curves that ``write_fitlc`` wrote, of all sources or of a few, whose buckets alone are read; or a folder of single files.

    Single files have a line ``band t mag emag`` for each point under a header; the source is the file's stem.
    """
    f = lambda line: F.split(F.trim(line), r"\s+")
    names = F.array(*map(F.lit, bands))
    point = lambda x: (F.get(names, x[0].cast("int")).alias("band"), x[1].cast("double").alias("t"), x[2].cast("double").alias("mag"), x[3].cast("double").alias("emag"))
    try:
        index = spark.read.parquet(f"{path}/index")
    except AnalysisException:  # single files
        rows = spark.read.option("recursiveFileLookup", True).text(path).withColumn("path", F.input_file_name()).where(~F.col("value").startswith("Band"))
        return rows.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("source_id"), *point(f(F.col("value"))))
    rows = spark.read.text(f"{path}/curves")
    if sources is not None:
        asked = index.where(F.col("source_id").isin(*sources)).select("bucket").distinct().collect()  # one for each source asked for, at most
        rows = rows.where(F.col("bucket").isin(*(r["bucket"] for r in asked)))
    rows = rows.select(F.substring_index("value", "\t", 1).alias("source_id"), *point(f(F.substring_index("value", "\t", -1))))
    return rows if sources is None else rows.where(F.col("source_id").isin(*sources))


def curve_file(lines: list[str]) -> str:
    """The text of one source's own file, for a fitter: a header and its lines."""
    return "\n".join(["Band time(days) mag(mag) mag_err", *lines]) + "\n"


def write_fd(rows: DataFrame, path: str) -> None:
    """Append decomposition rows as space-separated text with a header in each file."""
    rows.write.mode("append").option("header", True).option("sep", " ").csv(path)


def read_fd(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows written by ``write_fd``; ``schema`` is ``decompose.fd_schema``."""
    return spark.read.schema(schema).option("header", True).option("sep", " ").csv(path)


def write_quality(rows: DataFrame, path: str) -> None:
    """A quality table with its arrays."""
    rows.write.mode("overwrite").parquet(path)


#: fixed values: columns of the surveys' files, in their order
GAIA_WIDE = "g_transit_time double, g_transit_mag double, g_transit_flux double, g_transit_flux_error double, bp_obs_time double, bp_mag double, bp_flux double, bp_flux_error double, rp_obs_time double, rp_mag double, rp_flux double, rp_flux_error double, variability_flag_g_reject boolean, variability_flag_bp_reject boolean, variability_flag_rp_reject boolean, g_obs_time double, g_mag double, g_flux double, g_flux_error double"
ZTF_POINT = "mjd double, mag double, magerr double, catflags int, filtercode string"


def survey_files(spark: SparkSession, mode: str, phot: str) -> DataFrame:
    """All photometry files of a survey by the names of their columns, with ``file_id``, ``path, ord, error`` (see ``ecsv.read_files``).

    ``gaia``: ``epphot_DR3_{id}.ecsv`` anywhere under ``phot``, the g band from ``g_transit_*`` or else ``g_*`` columns. ``ztf``: ``ztf_{id}.ecsv`` in ``phot`` itself or
    else in its folder ``epoch_phot``: where both are there the first counts, even if it is a bad one.
    """
    if mode == "gaia":
        rows = ecsv.read_files(spark, phot, "epphot_DR3_*.ecsv", GAIA_WIDE, ("bp_obs_time", "rp_obs_time"))
        pairs = {f"g_transit_{x}": f"g_{y}" for x, y in (("time", "obs_time"), ("mag", "mag"), ("flux", "flux"), ("flux_error", "flux_error"))}
        rows = rows.withColumns({a: F.coalesce(a, b) for a, b in pairs.items()}).drop(*pairs.values())
        return rows.withColumn("file_id", F.regexp_extract("path", r"epphot_DR3_([0-9]+)\.ecsv$", 1).try_cast("long")).where("file_id is not null")
    rows = ecsv.read_files(spark, phot, "ztf_*.ecsv", ZTF_POINT, ("mjd", "mag", "magerr", "catflags", "filtercode"))
    rows = rows.withColumn("file_id", F.regexp_extract("path", r"/ztf_([0-9]+)\.ecsv$", 1).try_cast("long")).where("file_id is not null")
    folder = re.escape(re.sub(r"^[a-z]+:/*", "/", phot).rstrip("/"))
    place = F.when(F.col("path").rlike(rf"{folder}/[^/]+$"), 0).when(F.col("path").rlike(rf"{folder}/epoch_phot/[^/]+$"), 1)
    first = F.min("place").over(W.partitionBy("file_id"))
    return rows.withColumn("place", place).withColumn("first", first).where("place = first").drop("place", "first")


def load(spark: SparkSession, mode: str, ident: DataFrame, phot: str, match: DataFrame | None = None) -> DataFrame:
    """The canonical epochs of the identified sources, from a survey's folder of photometry.

    ``ogle``: ``{phot}/{catalogue}/{band}/{ID}.dat`` and ident ``ID``; ``gaia``: files
    ``epphot_DR3_{SOURCE_ID}.ecsv`` anywhere under ``phot`` and ident ``SOURCE_ID``;
    ``ztf``: ``ztf_{ztf_id}.ecsv`` files, ident ``ID`` and the cross-match table
    ``ID, ztf_id, sep``. Sources without files, or with bad ones only, have no rows (``survey_files`` and ``ecsv.bad_files`` tell them).
    """
    if mode == "ogle":
        return read_ogle(spark, phot).join(ident.select(F.col("ID").alias("source_id")).distinct(), "source_id", "left_semi")
    if mode == "gaia":
        wide = survey_files(spark, mode, phot).where("error is null").withColumnRenamed("file_id", "source_id")
        return unpivot_gaia(wide).join(ident.select(F.col("SOURCE_ID").cast("long").alias("source_id")).distinct(), "source_id", "left_semi")
    if mode == "ztf":
        if match is None:
            raise ValueError("ztf needs a cross-match table")
        rows = survey_files(spark, mode, phot).where("error is null").withColumnRenamed("file_id", "ztf_id").drop("ord", "path", "error")
        own = crossmatch(match.join(ident.select("ID").distinct(), "ID", "left_semi"), rows)
        epochs = ztf_epochs(own.withColumn("source_id", F.col("ID")))
        return epochs.withColumn("ord", F.xxhash64("t", "mag", "emag"))
    raise ValueError(f"unknown mode {mode!r}")


def monitor(rows: DataFrame, reject: Column) -> DataFrame:
    """``source_id, total, rejected`` of epochs before the cut, and the distinct bands."""
    return rows.groupBy("source_id").agg(F.count("*").alias("total"), F.count_if(F.coalesce(reject, F.lit(False))).alias("rejected"), F.count_distinct("band").alias("bands"))


def pulsation(ident: DataFrame, mode: str) -> DataFrame:
    """``source_id, pulsation``: the catalogue's label, type and mode joined by ``_`` for gaia, none for ztf."""
    if mode == "gaia":
        return ident.select(F.col("SOURCE_ID").alias("source_id"), F.concat_ws("_", "type_best_classification", "mode_best_classification").alias("pulsation"))
    return ident.select(F.col("ID").alias("source_id"), (F.col("pulsation") if mode == "ogle" else F.lit(None).cast("string")).alias("pulsation"))


def gaia_magnitude(flux: Column, error: Column, band: Column) -> tuple[Column, Column]:
    """Calibrated magnitude and its error; the error has no 1/ln 10, as the surveys' pipeline has it, and is infinite where the flux is 0, so that the point weighs nothing."""
    zp = F.create_map(*(F.lit(x) for kv in ZERO_POINT.items() for x in kv))
    ze = F.create_map(*(F.lit(x) for kv in ZERO_POINT_ERROR.items() for x in kv))
    mag = -2.5 * F.log10(F.greatest(flux, F.lit(1e-30))) + zp[band]
    relative = F.when(flux == 0, F.lit(float("inf"))).otherwise(F.try_divide(error, flux))
    return mag, F.sqrt(F.pow(-2.5 * relative, F.lit(2.0)) + F.pow(ze[band], F.lit(2.0)))


def unpivot_gaia(wide: DataFrame, bands: tuple[str, ...] = ("g", "bp", "rp")) -> DataFrame:
    """Wide Gaia epochs to long ones: per band, without masked or rejected rows."""

    def one(b: str) -> DataFrame:
        pre = "g_transit" if b == "g" and "g_transit_mag" in wide.columns else b
        time = "g_transit_time" if b == "g" else f"{b}_obs_time"
        mag, emag = gaia_magnitude(F.col(f"{pre}_flux"), F.col(f"{pre}_flux_error"), F.lit(b))
        good = F.col(f"{pre}_mag").isNotNull() & ~F.coalesce(F.col(f"variability_flag_{b}_reject"), F.lit(False))
        return wide.where(good).select("source_id", F.lit(b).alias("band"), F.col(time).alias("t"), mag.alias("mag"), emag.alias("emag"), "ord")

    return reduce(DataFrame.unionByName, map(one, bands))


def ztf_epochs(rows: DataFrame, bands: tuple[str, ...] = ("zg", "zr", "zi"), compat: bool = False) -> DataFrame:
    """Quality cut and names; ``compat`` keeps the historical operator precedence (any even flag, and bad errors, pass)."""
    fine = F.col("magerr").isNotNull() & ~F.isnan("magerr") & (F.col("magerr") >= 0)
    good = (~fine | (F.col("catflags") % 2 == 0)) if compat else (fine & (F.col("catflags") == 0))
    return rows.where(good & F.col("filtercode").isin(*bands)).select("source_id", F.col("filtercode").alias("band"), F.col("mjd").alias("t"), "mag", F.col("magerr").alias("emag"))


def crossmatch(match: DataFrame, photometry: DataFrame, most: float = 0.1) -> DataFrame:
    """Photometry of the distinct finite matches within ``most``."""
    good = match.where(f"sep <= {most}e0 and not isnan(sep) and ztf_id >= 0").select("ID", "ztf_id").distinct()
    return photometry.join(good, "ztf_id")


def event_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs that stand on the ``events`` table: users are sources, three event types are bands."""
    band = F.create_map(*map(F.lit, ("click", "g", "view", "bp", "purchase", "rp")))[F.col("event_type")]
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type").isin("click", "view", "purchase"))
    rows = rows.where(~F.coalesce(F.get_json_object("props", "$.k").cast("int") % 10 == 0, F.lit(False)))
    mag, emag = gaia_magnitude(F.col("value"), 0.02 * F.col("value") + 0.01, F.col("band"))
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86400e6) - 19723
    return rows.withColumn("band", band).select(F.col("user_id").alias("source_id"), "band", t.alias("t"), mag.alias("mag"), emag.alias("emag"), F.col("event_id").alias("ord"))
