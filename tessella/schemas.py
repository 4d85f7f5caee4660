"""Schemas of the study's tables."""

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, L, D, I, TS = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.TimestampType()

#: Rows of a detector's CSV file, relative to the tile.
CSV = _schema(label=S, confidence=D, x1=L, y1=L, x2=L, y2=L, x_correct=L, y_correct=L)
DETECTIONS = _schema(
    det_id=L, slide_id=S, overlap_pct=D, label=S, confidence=D, x1=L, y1=L, x2=L, y2=L, cx=D, cy=D, x_correct=L, y_correct=L, tile_x=L, tile_y=L
)
SLIDES = _schema(slide_id=S, image_path=S, image_w=L, image_h=L, n_tiles_x=L, n_tiles_y=L)
CELL_COUNTS = _schema(slide_id=S, overlap_pct=D, nms_method=S, label=S, count=L, rel_count=D)
TILE_COUNTS = _schema(slide_id=S, overlap_pct=D, nms_method=S, tile_x=L, tile_y=L, label=S, count=L)
BLOCK_COUNTS = _schema(slide_id=S, overlap_pct=D, nms_method=S, block_size=L, block_x=L, block_y=L, label=S, count=L, n_block_total=L)
BLOCK_CONSENSUS = _schema(
    slide_id=S, overlap_pct=D, block_size=L, block_x=L, block_y=L, consensus_alr_Mac=D, consensus_alr_Neu=D, consensus_alr_Eos=D,
    n_methods_in_consensus=L, n_block_total=L,
)
METHOD_DEVIATION = _schema(slide_id=S, overlap_pct=D, block_size=L, block_x=L, block_y=L, nms_method=S, aitchison_distance=D, mahalanobis_distance=D)
TIMING = _schema(slide_id=S, overlap_pct=D, nms_method=S, repeat=I, n_detections=L, elapsed_cpu=D, elapsed_wall=D)
MANIFEST = _schema(slide_id=S, overlap_pct=D, nms_method=S, status=S, error_msg=S, finished_at=TS)

TABLES = {
    "slides": SLIDES, "raw_detections": DETECTIONS, "cell_counts": CELL_COUNTS, "tile_counts": TILE_COUNTS, "timing": TIMING,
    "checkpoint": MANIFEST, "block_counts": BLOCK_COUNTS, "block_consensus": BLOCK_CONSENSUS, "method_deviation": METHOD_DEVIATION,
}
