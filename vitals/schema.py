"""Table schemas and the fixed dictionaries of the export format."""

from __future__ import annotations

import re

# Identifiers of the measurement types that are ingested.
RECORD_IDENTIFIERS = """
HKQuantityTypeIdentifierHeartRate
HKQuantityTypeIdentifierHeartRateVariabilitySDNN
HKQuantityTypeIdentifierBloodPressureSystolic
HKQuantityTypeIdentifierBloodPressureDiastolic
HKQuantityTypeIdentifierOxygenSaturation
HKQuantityTypeIdentifierRespiratoryRate
HKQuantityTypeIdentifierRestingHeartRate
HKQuantityTypeIdentifierWalkingHeartRateAverage
HKCategoryTypeIdentifierSleepAnalysis
HKQuantityTypeIdentifierStepCount
HKQuantityTypeIdentifierDistanceWalkingRunning
HKQuantityTypeIdentifierActiveEnergyBurned
HKQuantityTypeIdentifierBasalEnergyBurned
HKQuantityTypeIdentifierAppleExerciseTime
HKQuantityTypeIdentifierBodyMass
HKQuantityTypeIdentifierBodyMassIndex
HKQuantityTypeIdentifierBodyTemperature
HKQuantityTypeIdentifierPhysicalEffort
HKQuantityTypeIdentifierRunningPower
HKQuantityTypeIdentifierRunningSpeed
HKQuantityTypeIdentifierRunningStrideLength
HKQuantityTypeIdentifierRunningVerticalOscillation
HKQuantityTypeIdentifierRunningGroundContactTime
HKQuantityTypeIdentifierEnvironmentalAudioExposure
HKQuantityTypeIdentifierHeadphoneAudioExposure
HKQuantityTypeIdentifierVO2Max
HKQuantityTypeIdentifierWalkingSpeed
HKQuantityTypeIdentifierWalkingStepLength
HKQuantityTypeIdentifierWalkingAsymmetryPercentage
HKQuantityTypeIdentifierWalkingDoubleSupportPercentage
HKQuantityTypeIdentifierStairAscentSpeed
HKQuantityTypeIdentifierStairDescentSpeed
HKQuantityTypeIdentifierSixMinuteWalkTestDistance
HKQuantityTypeIdentifierAppleWalkingSteadiness
HKQuantityTypeIdentifierFlightsClimbed
HKQuantityTypeIdentifierDistanceCycling
HKQuantityTypeIdentifierDistanceSwimming
HKQuantityTypeIdentifierSwimmingStrokeCount
HKQuantityTypeIdentifierHeight
HKQuantityTypeIdentifierLeanBodyMass
HKQuantityTypeIdentifierBodyFatPercentage
HKQuantityTypeIdentifierBloodGlucose
HKQuantityTypeIdentifierInsulinDelivery
HKQuantityTypeIdentifierDietaryEnergyConsumed
HKQuantityTypeIdentifierDietaryCarbohydrates
HKQuantityTypeIdentifierDietaryFatTotal
HKQuantityTypeIdentifierDietaryProtein
HKQuantityTypeIdentifierDietaryWater
HKQuantityTypeIdentifierUVExposure
HKQuantityTypeIdentifierTimeInDaylight
HKCategoryTypeIdentifierMindfulSession
HKCategoryTypeIdentifierHighHeartRateEvent
HKCategoryTypeIdentifierLowHeartRateEvent
HKCategoryTypeIdentifierIrregularHeartRhythmEvent
HKCategoryTypeIdentifierAppleWalkingSteadinessEvent
""".split()

# The stored short name is the identifier without its class prefix.
RECORD_TYPES = {
    name: re.sub("^HK(Quantity|Category)TypeIdentifier", "", name)
    for name in RECORD_IDENTIFIERS
}

# Types a metrics query may ask for.
QUERYABLE_TYPES = """
HeartRate
HeartRateVariabilitySDNN
BloodPressureSystolic
BloodPressureDiastolic
RestingHeartRate
OxygenSaturation
BodyTemperature
RespiratoryRate
StepCount
DistanceWalkingRunning
BasalEnergyBurned
ActiveEnergyBurned
FlightsClimbed
BodyMass
Height
WalkingHeartRateAverage
EnvironmentalAudioExposure
HeadphoneAudioExposure
WalkingSpeed
WalkingStepLength
WalkingDoubleSupportPercentage
WalkingAsymmetryPercentage
SixMinuteWalkTestDistance
AppleStandTime
AppleExerciseTime
""".split()

# Query bounds, as (default, maximum) rows of a page.
METRIC_LIMITS = (100, 1000)
ECG_LIMITS = (50, 200)
WORKOUT_LIMITS = (50, 200)
MAX_RANGE_DAYS = 90
RECENT_JOBS = 20
SUMMARY_JOBS = 5
SUMMARY_DAYS = 7

# Largest archive that is opened, and the job states in their order.
MAX_ARCHIVE_BYTES = 2 * 1024**3
PENDING, VALIDATING, PROCESSING = "PENDING", "VALIDATING", "PROCESSING"
COMPLETED, FAILED = "COMPLETED", "FAILED"
JOB_STATES = [PENDING, VALIDATING, PROCESSING, COMPLETED, FAILED]

RECORDS = (
    "user_id STRING, record_type STRING, start_date STRING, value STRING, "
    "unit STRING, creation_date STRING, job_id STRING, value_num DOUBLE, "
    "_ingested LONG, _blk LONG, _pos LONG"
)
ECG = (
    "user_id STRING, ecg_time STRING, ordinal LONG, source_file STRING, "
    "classification STRING, average_heart_rate STRING, created_at STRING, "
    "job_id STRING, row_in_file LONG, _ingested LONG"
)
ROUTES = (
    "user_id STRING, route_time STRING, ordinal LONG, source_file STRING, "
    "waypoint_count INT, start_lat STRING, start_lon STRING, end_lat STRING, "
    "end_lon STRING, created_at STRING, job_id STRING, row_in_file LONG, "
    "_ingested LONG"
)
JOBS = (
    "user_id STRING, job_id STRING, status STRING, updated_at STRING, "
    "error_step STRING"
)
REJECTS = "user_id STRING, job_id STRING, source_file STRING, line LONG, reason STRING, _ingested LONG"
USERS = (
    "id STRING, email STRING, email_verified BOOLEAN, created_at STRING, "
    "updated_at STRING, status STRING, "
    "profile STRUCT<given_name: STRING, family_name: STRING, name: STRING>"
)



def column_names(schema: str) -> list[str]:
    """Top-level column names of one of the schemas above."""
    return re.findall(r"(?:^|, )(\w+) (?=[A-Z])", schema)


# family -> (schema, key columns, columns whose greatest value is the newest)
TABLES = {
    "rejects": (REJECTS, ["user_id", "job_id", "source_file", "line"], ["_ingested"]),
    "records": (
        RECORDS,
        ["user_id", "record_type", "start_date"],
        ["_ingested", "job_id", "_blk", "_pos"],
    ),
    "ecg": (
        ECG,
        ["user_id", "source_file", "row_in_file", "ecg_time"],
        ["_ingested", "job_id", "ordinal"],
    ),
    "routes": (
        ROUTES,
        ["user_id", "source_file", "row_in_file", "route_time"],
        ["_ingested", "job_id", "ordinal"],
    ),
    "jobs": (JOBS, ["user_id", "job_id"], ["updated_at", "status"]),
    "job_states": (JOBS, ["user_id", "job_id", "status"], ["updated_at"]),
    "users": (USERS, ["id"], ["updated_at", "created_at"]),
}
