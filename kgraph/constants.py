"""Fixed values. They must equal the published ones for results to match."""

# Extraction and alignment: candidates kept, aligned floor, shortest usable
# description, floor written for an unaligned concept.
RETRIEVE_TOP_K = 10
MIN_CONFIDENCE = 0.3
MIN_DESCRIPTION_LENGTH = 20
UNALIGNED_CONFIDENCE_FLOOR = 0.01

# Rerank weights, in the order they are added.
WEIGHT_SIMILARITY = 0.40
WEIGHT_COOCCURRENCE = 0.35
WEIGHT_LEVEL_PROXIMITY = 0.20
WEIGHT_DEPARTMENT_PRIOR = 0.05
DEPARTMENT_PRIOR = 0.05
CONFIDENCE_TEMPERATURE = 0.10
TEMPERATURE_FLOOR = 1e-6
CORE_DEPTH = 0.3
ELECTIVE_DEPTH = 0.7
ORDERING_SLACK = 0.5

# Dependency inference.
WEIGHT_COURSE_LEVEL = 0.45
WEIGHT_PREREQUISITE_PRIOR = 0.40
WEIGHT_KU_COOCCURRENCE = 0.15
MIN_DEPENDENCY_SCORE = 0.55
PRIOR_DIRECT = 1.0
PRIOR_TWO_HOPS = 0.5
PRIOR_FURTHER = 0.3
PRIOR_MAX_HOPS = 5
SAME_AREA = 1.0
OTHER_AREA = 0.5
LEVEL_WHEN_UNKNOWN = 3
NORMALISED_LEVEL_WHEN_UNKNOWN = 0.5
BAND_HIGH = 0.70
BAND_MEDIUM = 0.40
REJECTION_ALARM_PCT = 20.0
SIMILARITY_LOW = 0.5
SIMILARITY_FLOOR = 0.01

# Evaluation.
HELD_OUT_FRACTION = 0.20
RANDOM_SEED = 42
POOR_F1 = 0.40
DISTRACTOR_RATIO = 1.0
REACH_MAX_HOPS = 5
BAND_RANGES = {"high": (0.70, 1.01), "medium": (0.40, 0.70), "low": (0.0, 0.40)}
JUDGEMENT_LABELS = ("correct", "plausible_but_wrong", "incorrect")

# Query services.
RESOLVE_TOP_K = 15
RESOLVE_MIN_SCORE = 0.3
MATCH_MIN_CONFIDENCE = 0.5
MIN_COVERAGE_COURSES = 1
MAX_COMBINATIONS = 5
COMBINATION_POOL = 20
EXCERPT_LENGTH = 200
NO_ORDER_MESSAGE = "No ordering constraint is published between these courses."
COVERAGE_CAVEAT = (
    "Coverage is inferred from course descriptions and may not reflect "
    "actual course content."
)
STATUS_NO_CONCEPTS = (
    "Could not resolve your interest to any known concepts. "
    "Try rephrasing with more specific technical terms."
)
STATUS_COURSE_NOT_FOUND = "No course '%s' is present in the catalogue graph."
STATUS_NO_COURSES = (
    "No courses with concepts aligned to your interest were found. "
    "Try related terms."
)
GUARD_PATTERNS = (
    r"\bexempt\b",
    r"\byou (?:will|can|should) master\b",
    r"\bcovers everything\b",
    r"\ball you need\b",
    r"\bfully prepares?\b",
    r"\byou can skip\b",
)

# Ingestion.
INGEST_FAILURE_ALARM_PCT = 10.0
DEFAULT_CREDITS = 3.0
COURSE_CODE = r"\b([A-Z]{2,5})\s+(\d{5}[A-Z]?)\b"
SHORT_COURSE_CODE = r"\b([A-Z]{2,4})\s*(\d{3,4})\b"
PREREQUISITE_PROSE = (r"Prerequisite[:\s]+([^.]+)", r"Prereq[:\s]+([^.]+)")
CONCEPT_LIST_KEYS = ("concepts", "labels", "items", "results", "concept_list")

# Patterns and marks of landed pages.
BLOCK_TITLE = r"^([A-Z]+)\s*(\d+)\s+(.+?)\s+credit:\s*([\d.]+)\s+Hour"
COURSE_TITLE = r"\b([A-Z]{2,5})\s+(\d{5}[A-Z]?)\s*[-–]\s*(.+)"
CREDIT_COLON = r"Credit\s+Hours?\s*:\s*(\d+(?:\.\d+)?)"
CREDIT_SPAN = r"(\d+(?:\.\d+)?)\s+to\s+(\d+(?:\.\d+)?)\s+(?:Credit\s+Hours?|credits?)"
CREDIT_FIXED = r"(\d+(?:\.\d+)?)\s+(?:Credit\s+Hours?|credits?)"
PREREQ_TEXT = r"(?:Prerequisites?|Pre-requisites?)\s*:?\s*(.*?)(?:\n|\.(?:\s|$)|$)"
CROSS_LISTED = r"(?:Same as|Also offered as|Cross-listed with)\s+([A-Z]{2,5}\s+\d{5}[A-Z]?)"
HOURS = r"(\d+)\s+(?:credit\s+hours?|hours?|credits?)"
GPA = r"(\d+\.\d+)\s+GPA"
SYLLABUS_HEAD = "Detailed Syllabus:"
FOOTER_MARKERS = ("\nHome\n", "\nContact", "\n© ", "\nPurdue University,")

# Ablation modes.
RETRIEVAL_ONLY = "retrieval_only"
RETRIEVAL_RERANK = "retrieval_rerank"
FULL_PIPELINE = "full_pipeline"
