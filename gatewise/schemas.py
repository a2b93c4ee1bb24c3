"""Explicit schemas of stored tables and in-flight records."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()

IMAGE_PATHS = (
    "under_vehicle_image_path",
    "highlighted_image_path",
    "driver_image_path",
    "anpr_image_path",
    "overview_image_path",
    "plate_crop_image_path",
)

SCAN_EVENTS = _struct(
    ("id", L),
    ("timestamp", T.TimestampNTZType()),
    ("lane_name", S),
    ("plate_text", S),
    ("plate_state_name", S),
    ("speed_mps", D),
    ("plate_text_valid", B),
    ("foreign_object_detected", B),
    ("driver_name", S),
    ("admission", I),
    ("dossier_notes", S),
    *((p, S) for p in IMAGE_PATHS),
)

REGISTRY_JSON = _struct(
    ("LicensePlate", S), ("OwnerName", S), ("Classification", I), ("Notes", S), ("Id", L)
)
REGISTRY = _struct(("id", L), ("license_plate", S), ("owner_name", S), ("classification", I), ("notes", S))

CONTROLLERS = _struct(
    ("id", I), ("lane_id", S), ("gate_name", S), ("ip", S), ("interlock_source", S),
    ("loop_positions", S), ("tcp_port", I), ("debounce_ms", I), ("enabled", B),
)
IP_CAMERAS = _struct(("id", I), ("lane_id", S), ("camera_name", S), ("ip", S), ("enabled", B), ("source", S))
UNDERBODY_CAMERAS = _struct(("id", I), ("lane_id", S), ("camera_name", S), ("device_serial", S), ("source", S))

EVAL_REPORT = _struct(
    ("filename", S), ("label", S), ("text", S), ("confidence", D), ("variant", S), ("correct", B)
)
BANK = _struct(("bank_id", L), ("feat", T.ArrayType(T.FloatType())))
LOOP_STATE = _struct(("lane", S), ("ts", T.TimestampNTZType()), ("seq", L), ("loops", T.ArrayType(B)))

ADMISSION_NAMES = {0: "Approved", 1: "Pending", 2: "Denied"}
CLASSIFICATION_NAMES = {0: "Normal", 1: "Whitelist", 2: "Blacklist"}
APPROVED, PENDING, DENIED = 0, 1, 2
NORMAL, WHITELIST, BLACKLIST = 0, 1, 2
