"""Block assets against a flood fill of the cell classes; exports and readers on disk."""
import numpy as np

from terratally.operators import assets as A, blocks, gis
from terratally.session import new_dir
from terratally.sources import exports, fixtures as X, ingest
from tests.test_raster import flood

SF = "/root/testdata/sf0.001"


def test_blocks(spark):
    px = X.pixels(spark, SF).where("image_id < 2")
    images = X.images(spark, SF).where("image_id < 2")
    cells = blocks.grid_classes(px).collect()
    names = sorted({c.category for c in cells})
    grid = np.zeros((2, 23, 35), int)
    for c in cells:
        grid[c.image_id, c.y, c.x] = names.index(c.category)
    got = {(r.image_id, r.asset_idx): r for r in blocks.block_assets(px, images).collect()}
    n = 0
    for i, g in enumerate(grid):
        firsts = []
        for k, name in enumerate(names):
            lab = flood(g == k, 4)
            firsts += [(c, name, lab == c) for c in np.unique(lab[lab >= 0])]
        for idx, (_, name, part) in enumerate(sorted(firsts, key=lambda f: f[0]), 1):
            n += 1
            r = got[(i, idx)]
            ys, xs = np.nonzero(part)
            assert (r.category, r.estimated_count, r.unique_id) == (name, part.sum(), f"auto_block_{idx - 1}")
            assert r.confidence_percent == min(85 + 2 * part.sum(), 99)
            assert np.allclose(tuple(r.bounding_box), (xs.min() / 35 * 100, ys.min() / 23 * 100, (xs.max() + 1) / 35 * 100, (ys.max() + 1) / 23 * 100))
    assert n == len(got)


def test_files(spark):
    assets = A.fill_asset_defaults(X.raw_assets(spark, SF))
    out = new_dir(spark, "exports")
    rows = A.asset_rows(assets)
    exports.write_csv(rows, out + "/csv")
    back = spark.read.csv(out + "/csv", header=True, escape='"')
    assert back.columns == ["image_id", *exports.K.CSV_COLUMNS]
    assert back.count() == rows.count()
    exports.write_geojson(exports.to_geojson(gis.gis_polygons(assets)), out + "/geo")
    assert spark.read.text(out + "/geo").count() == rows.count()
    assert ingest.scan_responses(spark, out + "/geo").count() >= 1
    manifest = ingest.file_manifest(spark, out + "/geo")
    assert manifest.where("size_bytes > 0").count() >= 1
    X.frames(spark, SF).write.parquet(out + "/frames")
    assert ingest.read_frames(spark, out + "/frames").count() == 1000
    assert ingest.read_frames(spark, out + "/frames", stream=True).isStreaming


def test_colours_of_words(spark):
    """Words give back every pixel that is there, and no other."""
    rows = [(i, 130, 3, y, x, (x * 7 + i) % 256, (y * 90 + x) % 256, 255 - x) for i in range(2) for y in range(3) for x in range(130) if (x + y) % 5]
    px = spark.createDataFrame(rows, "image_id bigint, w int, h int, y int, x int, r int, g int, b int")
    back = blocks.word_colours(blocks.colour_words(px), "image_id", "w", "h", "y")
    assert sorted(map(tuple, back.select(px.columns).collect())) == sorted(rows)
