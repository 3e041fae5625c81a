"""Input and output schemas.  No input type is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _struct(columns: str) -> T.StructType:
    """Schema from ``name type`` pairs, without needing a session."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


TICKETS = _struct("""
    REQUEST_ID bigint, PARENT_REQUEST_ID bigint, RFC_NUMBER string,
    CREATION_DATE_UT timestamp_ntz, SUBMIT_DATE_UT timestamp_ntz,
    END_DATE_UT timestamp_ntz, MAX_RESOLUTION_DATE_UT timestamp_ntz,
    LAST_UPDATE timestamp_ntz,
    SUBMITTED_BY bigint, SUBMITTED_BY_LAST_NAME string,
    REQUESTOR_ID bigint, REQUESTOR_LAST_NAME string,
    REQUESTOR_LOCATION_RH string, LOCATION_ID bigint, REQUESTOR_PHONE string,
    RECIPIENT_ID bigint, RECIPIENT_LAST_NAME string,
    RECIPIENT_LOCATION_RH string,
    SD_CATALOG_ID bigint, CATALOG_NAME string,
    STATUS_ID bigint, STATUS_FR string,
    COMMENT string, DESCRIPTION string,
    URGENCY_ID bigint, URGENCY_FR string,
    CI_ID bigint, CI_NAME string,
    OWNER_ID bigint, OWNER_LAST_NAME string,
    OWNING_GROUP_ID bigint, OWNING_GROUP_NAME string,
    DEPARTMENT_ID bigint, REQUESTOR_FEEDBACK string,
    ASSET_ID bigint, ASSET_TAG string,
    FIRST_CALL_RESOLUTION int, SEVERITY_ID bigint,
    TIME_USED_TO_SOLVE_REQUEST bigint, REQUEST_ORIGIN_ID bigint,
    DELAY bigint, LAST_GROUP_ID bigint, LAST_DONE_BY_ID bigint,
    SLA_ID bigint, IMPACT_ID bigint, E_INFRA_COMMENT string,
    IS_MAJOR_INCIDENT int, E_TYPE_SUPPORT string
""")

ACTIONS = _struct("""
    ACTION_ID bigint, REQUEST_ID bigint, RFC_NUMBER string,
    ACTION_NUMBER bigint, ASSET_ID bigint, PARENT_ACTION_ID bigint,
    VALIDATOR_ID bigint, ACTION_LABEL_FR string, ACTION_TYPE_ID bigint,
    ACTION_TYPE string,
    START_DATE_UT timestamp_ntz, END_DATE_UT timestamp_ntz,
    EXPECTED_START_DATE_UT timestamp_ntz, CREATION_DATE_UT timestamp_ntz,
    EXPECTED_END_DATE_UT timestamp_ntz, LAST_UPDATE timestamp_ntz,
    DESCRIPTION string, PROCESS_STEP_ID bigint, LOCATION_ID bigint,
    DONE_BY_ID bigint, DONE_BY_NAME string, GROUP_ID bigint, GROUP_FR string,
    CONTACT_ID bigint, ELAPSED_TIME bigint, STATUS_ID_ON_CREATE bigint,
    STATUS_ID_ON_TERMINATE bigint, TIME_USED_TO_COMPLETE_ACTION bigint,
    ORIGIN_ACTION_ID bigint, WORKFLOW_VALUE string, WORKFLOW_ID bigint,
    EXIT_VALUE string, PREVIOUS_SIBLING_ID bigint, HISTORY_ID bigint
""")

ANSWERS = _struct("""
    REQUEST_ID bigint, RFC_NUMBER string, SD_CATALOG_ID bigint,
    QUESTION_ID bigint, RESULT string, RESULT_STRING_FR string
""")

EMPLOYEES = _struct("EMPLOYEE_ID bigint, LAST_NAME string, AVAILABLE_FIELD_6 string")
CATALOG = _struct("SD_CATALOG_ID bigint, TITLE_FR string")
STATUSES = _struct("STATUS_ID bigint, STATUS_FR string")
URGENCIES = _struct("URGENCY_ID bigint, URGENCY_FR string")
ASSETS = _struct("ASSET_ID bigint, NETWORK_IDENTIFIER string, ASSET_TAG string")
GROUPS = _struct("GROUP_ID bigint, GROUP_FR string")
ACTION_TYPES = _struct("ACTION_TYPE_ID bigint, NAME_FR string")

CLASSIFICATION = _struct("""
    id bigint, AP_REQUEST_ID bigint, AP_RFC_NUMBER string,
    AP_INTERVENTION_TYPE bigint
""")
INTERVENTION_TYPES = _struct("""
    id bigint, AP_TYPE string, AP_TYPE_FR string, AP_Description string,
    AP_Description_FR string
""")
TYPE_UPDATES = _struct("""
    AP_REQUEST_ID bigint, AP_TYPE_FR string, requested_at timestamp_ntz
""")


def with_text_dates(schema: T.StructType) -> T.StructType:
    """The same schema as found in delimited files: dates as text."""
    return T.StructType([
        T.StructField(f.name, T.StringType())
        if isinstance(f.dataType, T.TimestampNTZType) else f
        for f in schema.fields
    ])
