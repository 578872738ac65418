"""Declared schemas of the relations that pass between operators."""

from pyspark.sql import types as T

S, D, B, I = T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType()
A = T.ArrayType(S)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: One text of one packet; trust 0 is the most trusted stream.
STREAM = _struct(case_id=S, stream=S, trust=I, text=S)
#: One reading of one field.
CANDIDATE = _struct(case_id=S, field=S, value=S, stream=S, trust=I, pos=I)
#: One packet after fusion: the fields, where they came from, and what is doubtful about them.
EVIDENCE = _struct(
    case_id=S, applicant_name=S, species_code=S, home_world=S, visa_class=S, sponsor_id=S, arrival_date=S, declared_purpose=S,
    fee_status=S, risk_flags=A, finding=S, conflicts=A, untrusted_conflicts=A, sources_seen=A, observed_flags_seen=B,
    injection_heavy=B, trusted_text_chars=I, visa_source=S, arrival_source=S, fee_source=S, biometric_seen=B, positive_waiver_seen=B, observed_none=B,
)
#: One prediction, as it is written.
PREDICTION = _struct(
    case_id=S, applicant_name=S, species_code=S, home_world=S, visa_class=S, sponsor_id=S, arrival_date=S, declared_purpose=S,
    risk_flags=S, fee_status=S, adjudication=S, confidence=D,
)
TRUTH = T.StructType([f for f in PREDICTION.fields if f.name != "confidence"])
#: One count of the confusion model: op M, S, I or D.
CONFUSION = _struct(op=S, true_ch=S, obs_ch=S, n=T.LongType())
