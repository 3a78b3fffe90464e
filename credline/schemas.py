"""Schemas of the stage tables and the fixed values the operators depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being reproduced)
# ---------------------------------------------------------------------------

# Scene classification codes and the labels they map to; every other code is dropped.
CHYRON_CODES = ("I", "N", "Y")
CREDITS_CODES = ("C",)
CHYRON = "chyron"
CREDITS = "credits"

# Characters allowed as a one-character token by the OCR text cleaner.
ALLOWED_SHORT_TOKENS = ("&",)

# Confidence tiers of an OCR box: above HIGH is high, above MEDIUM is medium, else low.
CONF_HIGH = 0.8
CONF_MEDIUM = 0.5

# Frame sampling stride inside a detected time frame, and the assumed frame rate.
FRAME_STRIDE = 15
FRAMES_PER_SECOND = 30

# Skip reason that marks a frame as a duplicate of the frame before it.
REASON_DUPLICATE = "DUPLICATE"

# Guid pattern inside a media location (group 1 is the guid).
GUID_PATTERN = r"(cpb-aacip[-_][a-z0-9-]+)."
GUID_PREFIX = "cpb-aacip-"
CATALOG_PREFIX = "cpb-aacip_"

# Review stages of a batch, in order.
STAGES = ("1-ocr-in-progress", "2-ocr-complete", "3-llm-in-progress", "4-llm-complete")

# Columns of the stage files: review flags (default False), those that the review export drops.
REVIEW_FLAGS = ("ocr_accepted", "deleted", "label_adjusted", "annotated")
REVIEW_EXPORT_DROP = ("annotated", "label_adjusted", "deleted", "confidence")

# Strings that the pandas CSV reader turns into a missing value by default.
NA_LITERALS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Regex classes shared by Spark (Java) and the SQL oracle (RE2). Python's notion of whitespace
# for str.split(): ASCII space/tab/newline/CR/FF/VT, the separators 0x1c-0x1f, NEL and every
# Unicode separator (Z*). Java's and RE2's \s alone miss several of these.
WS_CLASS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
LETTER = r"\p{L}"
NON_WORD = r"[^\p{L}\p{N}_]"

# ---------------------------------------------------------------------------
# Stage table schemas
# ---------------------------------------------------------------------------

# E2: one flat OCR row per (guid, time point).
OCR_ROW = T.StructType([
    T.StructField("guid", T.StringType()),
    T.StructField("time_point", T.LongType()),
    T.StructField("scene_label", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("textdocument", T.StringType()),
])

# E4: a row under OCR review.
REVIEWED_ROW = T.StructType([
    *OCR_ROW.fields,
    T.StructField("path", T.StringType()),
    *[T.StructField(f, T.BooleanType()) for f in REVIEW_FLAGS],
    T.StructField("cleaned_text", T.StringType()),
])

# E5: a tagged row under adjudication.
TAGGED_ROW = T.StructType([
    *[f for f in REVIEWED_ROW.fields if f.name not in REVIEW_EXPORT_DROP],
    T.StructField("tagged", T.StringType()),
    T.StructField("adjudicated", T.BooleanType()),
    T.StructField("accepted", T.BooleanType()),
])

# E6: a final label row.
LABEL_ROW = T.StructType([
    *OCR_ROW.fields[:3],
    T.StructField("cleaned_text", T.StringType()),
    T.StructField("labels", T.StringType()),
])

# E3: guid -> media path.
PATH_DIM = T.StructType([
    T.StructField("guid", T.StringType()),
    T.StructField("path", T.StringType()),
])

# E10: one gold annotation of a frame.
GOLD_ROW = T.StructType([
    T.StructField("guid", T.StringType()),
    T.StructField("frame_num", T.LongType()),
    T.StructField("bindings", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("image_id", T.StringType()),
    T.StructField("continued_from", T.StringType()),
    T.StructField("skip_reason", T.StringType()),
])

# E12: a time frame of a video.
TIME_FRAME = T.StructType([
    T.StructField("guid", T.StringType()),
    T.StructField("tf_id", T.StringType()),
    T.StructField("start_frame", T.LongType()),
    T.StructField("end_frame", T.LongType()),
])

# E13: review action log; the payload of an edit is the corrected tagged text.
REVIEW_EVENT = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("action", T.StringType()),
    T.StructField("payload", T.StringType()),
])

# E1: annotation document (documents / views / annotations).
_ANN_PROPS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("timePoint", T.LongType()),
    T.StructField("classification", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("text", T.StructType([T.StructField("@value", T.StringType())])),
])
ANNOTATION_DOC = T.StructType([
    T.StructField("documents", T.ArrayType(T.StructType([
        T.StructField("@type", T.StringType()),
        T.StructField("properties", T.StructType([
            T.StructField("id", T.StringType()),
            T.StructField("mime", T.StringType()),
            T.StructField("location", T.StringType()),
        ])),
    ]))),
    T.StructField("views", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("annotations", T.ArrayType(T.StructType([
            T.StructField("@type", T.StringType()),
            T.StructField("properties", _ANN_PROPS),
        ]))),
    ]))),
    T.StructField("_corrupt", T.StringType()),
])

# E11: one OCR box (4 corner points, text, confidence).
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
OCR_BOX = T.StructType([
    T.StructField("bbox", T.ArrayType(POINT)),
    T.StructField("text", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])
