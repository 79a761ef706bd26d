from .measurements import (
    MEASURE_SCHEMA,
    cached_dataset,
    drop_label_records,
    read_measurements,
    write_table,
)

__all__ = [
    "MEASURE_SCHEMA",
    "cached_dataset",
    "drop_label_records",
    "read_measurements",
    "write_table",
]
