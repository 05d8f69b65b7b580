"""Fixed tables: every column is nullable text."""

from __future__ import annotations

from pyspark.sql import types as T

COLUMNS: dict[str, list[str]] = {
    "assignments": "reel_no frame_no last_update_date recorded_date purge_indicator page_count conveyance_text correspondent_name correspondent_address_1 correspondent_address_2 correspondent_address_3 correspondent_address_4".split(),
    "assignors": "reel_no frame_no name execution_date date_acknowledged".split(),
    "assignees": "reel_no frame_no name address_1 address_2 city state country_name postcode".split(),
    "properties": "reel_no frame_no invention_title doc_country doc_number doc_kind doc_name doc_date".split(),
}
ROLLUPS = "assignor_names assignee_names assignor_count assignee_count execution_date date_acknowledged transaction_date date_source".split()
COLUMNS["flat"] = COLUMNS["assignments"] + ROLLUPS + COLUMNS["properties"][2:]


def struct(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


#: A record: the header's fields and the three child lists, without the key that they share.
RECORD = T.StructType(
    [
        T.StructField("ordinal", T.LongType()),
        *struct(COLUMNS["assignments"]).fields,
        *[T.StructField(t, T.ArrayType(struct(COLUMNS[t][2:]))) for t in ("assignors", "assignees", "properties")],
    ]
)
