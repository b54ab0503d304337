"""Small rasters from ASCII art: ``#`` is ink."""


def ink(spark, *pictures):
    rows = [(i, y, x) for i, p in enumerate(pictures) for y, line in enumerate(p) for x, c in enumerate(line) if c == "#"]
    return spark.createDataFrame(rows, "image_id bigint, y int, x int")


def sizes(spark, *pictures):
    return spark.createDataFrame([(i, len(p), max(map(len, p))) for i, p in enumerate(pictures)], "image_id bigint, h int, w int")


def pixels(spark, *grids):
    rows = [(i, y, x, int(v)) for i, g in enumerate(grids) for y, line in enumerate(g) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "image_id bigint, y int, x int, v int")
