"""Explicit schemas of the raw inputs; nothing is inferred."""

from pyspark.sql import types as T

DAILY_CSV = T.StructType(
    [
        T.StructField("Date", T.StringType()),
        T.StructField("Mode", T.StringType()),
        T.StructField("Count", T.DoubleType()),
    ]
)

HOURLY_CSV = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "transit_timestamp",
            "station_complex_id",
            "station_complex",
            "borough",
            "ridership",
            "transfers",
        )
    ]
)

SKILLS_CSV = T.StructType(
    [T.StructField("job_link", T.StringType()), T.StructField("job_skills", T.StringType())]
)

# The fifteen posting columns the pipeline projects, all read as text and typed afterwards.
POSTING_COLUMNS = (
    "job_id",
    "company_name",
    "title",
    "description",
    "formatted_work_type",
    "remote_allowed",
    "normalized_salary",
    "location",
    "work_type",
    "currency",
    "formatted_experience_level",
    "skills_desc",
    "listed_time",
    "posting_domain",
    "company_id",
)
