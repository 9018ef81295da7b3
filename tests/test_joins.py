"""Tables that grow with the input are joined in shuffled parts, however small Spark takes them to be."""
from pyspark.sql import functions as F

from terratally import fixed_values as K
from terratally.functions import clean as C
from terratally.operators import heights as H, masks as M, ranking, regions as Q
from terratally.plans import modes
from terratally.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def plan(capsys, df) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_shadow_points_are_not_broadcast(spark, capsys):
    regions = H.box_shadows(X.shadows(spark, SF))
    matched = regions.select("image_id", "shadow_id", *[F.lit(v).alias(n) for n, v in (("x1", 1), ("y1", 1), ("x2", 9), ("y2", 9))])
    far = H.shadow_length(H.farthest_point(matched, H.box_shadow_points(regions)))
    assert "Broadcast" not in plan(capsys, far)


def test_heights_and_reports_are_not_broadcast(spark, capsys):
    report = modes.analyze_naming(X.boxes(spark, SF), X.shadows(spark, SF))
    assert "Broadcast" not in plan(capsys, report)


def test_numbering_is_not_broadcast(spark, capsys):
    df = ranking.numbered(X.shadows(spark, SF), ["image_id"], F.col("shadow_id"), ["cx"], "n")
    assert "Broadcast" not in plan(capsys, df)


def test_words_are_not_broadcast_to_pixels(spark, capsys):
    px = X.pixels(spark, SF)
    words = px.groupBy("image_id", "y", F.floor(F.col("x") / 64).cast("int").alias("xb")).agg(*[F.count(F.lit(1)).alias(m) for m in M.MAP_MASKS])
    assert "Broadcast" not in plan(capsys, M.class_map_blend(px, words))


def test_regions_are_not_broadcast(spark, capsys):
    long = X.pixels(spark, SF).where("x < 64").groupBy("image_id", "w", "h", F.lit("m").alias("mask"), "y").agg(F.bit_or(F.expr("shiftleft(1L, x)")).alias("bits")).withColumn("xb", F.lit(0))
    lab = Q.labelled_regions(long, filled=True)
    assert "Broadcast" not in plan(capsys, lab)
    assert "Broadcast" not in plan(capsys, Q.keep_regions(lab, Q.region_stats(lab)))


def test_category_text_is_cleaned_once_a_row(spark, capsys):
    df = spark.createDataFrame([("Storm_Water drain",), (None,), ("",), ("Solar Panels",)], "c string")
    out = df.select(C.normalize_category(F.col("c")).alias("n"), C.class_to_category(F.col("c")).alias("k"))
    assert plan(capsys, out).count("lower(") == 3  # one in each chain, one for the alias
    assert [tuple(r) for r in out.collect()] == [
        ("Water Bodies", "Water Bodies"), (K.DEFAULT_CATEGORY,) * 2, (K.DEFAULT_CATEGORY,) * 2, ("Solar Panels", "Solar Panels")]


def test_calls_take_whole_tiles_of_bounded_number(spark):
    df = spark.range(6000).select((F.col("id") % 60).alias("image_id"), F.when(F.col("id") % 60 == 7, 0).otherwise(F.col("id") % 3).alias("_ty"), "id").repartition(1)

    def run(pdf):
        return pdf.groupby(["image_id", "_ty"], as_index=False).agg(n=("id", "size")).assign(call=len(pdf))

    got = Q.by_tile(df, ["image_id", "_ty"], run, "image_id bigint, _ty bigint, n bigint, call bigint", rows=50).collect()
    tiles = {(r.image_id, r._ty): r.n for r in df.groupBy("image_id", "_ty").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {(r.image_id, r._ty): r.n for r in got} == tiles and len(got) == len(tiles)
    assert max(r.call for r in got) < 6000
