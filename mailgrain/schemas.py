"""Fixed schemas of exports and stored tables; nothing is inferred."""

from pyspark.sql import types as T

_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


HEADER = _struct(name=_S, value=_S)
BODY = _struct(data=_S)
PART = _struct(mimeType=_S, filename=_S, body=BODY)

# Nested provider export: one JSON object per line.
GMAIL = _struct(
    id=_S,
    threadId=_S,
    internalDate=_S,
    payload=_struct(
        mimeType=_S,
        headers=T.ArrayType(HEADER),
        body=BODY,
        parts=T.ArrayType(PART),
    ),
)

# Flat provider export. `from` is a keyword, hence the explicit list.
PROTON = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("from", _S),
        T.StructField("to", T.ArrayType(_S)),
        T.StructField("subject", _S),
        T.StructField("body", _S),
        T.StructField("time", _L),
        T.StructField("headers", T.MapType(_S, _S)),
    ]
)

# The one message shape every operator takes.
MAIL = _struct(
    provider=_S,
    account=_S,
    message_id=_S,
    thread_id=_S,
    sender=_S,
    recipients=T.ArrayType(_S),
    subject=_S,
    date_received=_TS,
    body_text=_S,
    body_html=_S,
    headers=T.MapType(_S, _S),
    labels=T.ArrayType(_S),
    has_attachment=_B,
    seq=_L,
)

# A row of the relational store as it was dumped: nested values are JSON text, flags are 0/1.
STORED_MAIL = _struct(
    id=_L,
    message_id=_S,
    thread_id=_S,
    sender=_S,
    recipients=_S,
    subject=_S,
    date_received=_S,
    date_processed=_S,
    body_text=_S,
    body_html=_S,
    headers=_S,
    labels=_S,
    classification_priority=_S,
    classification_category=_S,
    confidence_score=_D,
    is_uncertain=_L,
    user_priority=_S,
    user_category=_S,
    feedback_date=_S,
    is_processed=_L,
    is_archived=_L,
    needs_review=_L,
    gmail_labels=_S,
)

STORED_EVENT = _struct(
    id=_L,
    email_id=_L,
    event_type=_S,
    title=_S,
    description=_S,
    start_datetime=_S,
    end_datetime=_S,
    location=_S,
    due_date=_S,
    priority=_S,
    gcal_event_id=_S,
    is_synced=_L,
    sync_approved=_L,
    reminder_status=_S,
    next_reminder_at=_S,
    created_at=_S,
    updated_at=_S,
)

CALENDAR_EVENT = _struct(
    id=_L,
    email_id=_L,
    event_type=_S,
    title=_S,
    description=_S,
    start_datetime=_TS,
    end_datetime=_TS,
    location=_S,
    due_date=_TS,
    priority=_S,
    gcal_event_id=_S,
    is_synced=_B,
    sync_approved=_B,
    reminder_status=_S,
    next_reminder_at=_TS,
    created_at=_TS,
    updated_at=_TS,
)

REMINDER = _struct(
    id=_L,
    event_id=_L,
    reminder_time=_TS,
    reminder_type=_S,
    sent_at=_TS,
    user_action=_S,
    snooze_until=_TS,
    notes=_S,
)

RAW_MESSAGE = _struct(
    message_id=_S,
    raw_message=T.BinaryType(),
    gmail_internal_date=_TS,
    last_fetched=_TS,
    is_deleted=_B,
)

TRAINING = _struct(
    email_id=_L,
    features=T.MapType(_S, _D),
    label_priority=_S,
    label_category=_S,
    confidence=_D,
    is_validated=_B,
    created_at=_TS,
)

MODEL_VERSION = _struct(
    version=_S,
    model_type=_S,
    model_path=_S,
    training_samples=_L,
    accuracy=_D,
    precision_by_class=T.MapType(_S, _D),
    recall_by_class=T.MapType(_S, _D),
    f1_by_class=T.MapType(_S, _D),
    created_at=_TS,
    is_active=_B,
)

FEATURE_IMPORTANCE = _struct(model_version_id=_L, feature_name=_S, importance_score=_D)

RULE = _struct(
    id=_L,
    name=_S,
    condition_type=_S,
    condition_value=_S,
    action_type=_S,
    action_value=_S,
    is_active=_B,
    priority=_L,
)

MESSAGE_HASH = _struct(message_id=_S, content_hash=_S, first_seen=_TS)

SENDER_STATS = _struct(
    sender_email=_S,
    sender_domain=_S,
    total_emails=_L,
    read_count=_L,
    reply_count=_L,
    archive_count=_L,
    delete_count=_L,
    avg_user_priority=_D,
    is_automated=_B,
    first_seen=_TS,
    last_seen=_TS,
)

ACTION = _struct(id=_L, email_id=_L, action_type=_S, action_value=_S, action_timestamp=_TS)

WEIGHT = _struct(provider=_S, account=_S, category=_S, pattern=_S, weight=_D, version=_L)
