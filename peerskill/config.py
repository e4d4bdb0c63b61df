"""Constants shared by every job.

Everything in the FIXED VALUES block must equal the values the original
pipeline uses, otherwise scores, vectors and rankings differ.  Everything
else is a tunable default.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original pipeline for identical results)
# ---------------------------------------------------------------------------

# Tag vocabulary, in its canonical order (the order of vector coordinates,
# pivot columns and first-on-tie rules).
TAGS = [
    "dp", "greedy", "graphs", "math", "strings", "impl", "binary_search",
    "data_structures", "number_theory", "combinatorics", "geometry", "trees",
    "sortings", "two_pointers", "bitmasks", "flows", "fft", "games",
    "probabilities", "constructive",
]

# Long display names of the tags, in the order of TAGS.
TAG_LABELS = {
    "dp": "Dynamic Programming", "greedy": "Greedy", "graphs": "Graphs", "math": "Math", "strings": "Strings",
    "impl": "Implementation", "binary_search": "Binary Search", "data_structures": "Data Structures",
    "number_theory": "Number Theory", "combinatorics": "Combinatorics", "geometry": "Geometry", "trees": "Trees",
    "sortings": "Sortings", "two_pointers": "Two Pointers", "bitmasks": "Bitmasks", "flows": "Flows", "fft": "FFT",
    "games": "Games", "probabilities": "Probabilities", "constructive": "Constructive",
}

# Raw (lower-cased) tag name -> canonical tag.  Union of both raw maps
# ("graph matchings" from one, "dfs and similar"/"shortest paths" from the other).
RAW_TAG_MAP = {
    "dp": "dp",
    "greedy": "greedy",
    "graphs": "graphs",
    "graph matchings": "graphs",
    "dfs and similar": "graphs",
    "shortest paths": "graphs",
    "math": "math",
    "strings": "strings",
    "implementation": "impl",
    "binary search": "binary_search",
    "data structures": "data_structures",
    "number theory": "number_theory",
    "combinatorics": "combinatorics",
    "geometry": "geometry",
    "trees": "trees",
    "sortings": "sortings",
    "two pointers": "two_pointers",
    "bitmasks": "bitmasks",
    "flows": "flows",
    "fft": "fft",
    "games": "games",
    "probabilities": "probabilities",
    "constructive algorithms": "constructive",
}

MAX_RATING = 3500            # rating scale of difficulty / rating boost
SMOOTHING = 2                # Laplace smoothing: (ac + 1) / (n + 2)
VOLUME_CAP = 50              # volume = ln(1+ac) / ln(1+50)
DEFAULT_RATING = 1200        # rating used when the user has none

# Skill-table weights (sum to 1).
STRENGTH_WEIGHTS = {
    "acceptance_rate": 0.30,
    "difficulty_score": 0.30,
    "rating_boost": 0.20,
    "specialization_score": 0.10,
    "efficiency_score": 0.075,
    "volume_score": 0.075,
}

# Peer-benchmark weights (sum to 1), 0-100 strength.
PEER_WEIGHTS = {
    "acceptance": 0.35,
    "difficulty": 0.35,
    "specialization": 0.10,
    "volume": 0.20,
}

# KNN vector layout: 4 tag-level features x 20 tags (feature-major) + 2 user-level.
VECTOR_TAG_FEATURES = ["acceptance_rate", "difficulty_score", "specialization_score", "volume_score"]
VECTOR_USER_FEATURES = ["rating_boost", "efficiency_score"]

K_NEIGHBORS = 50
MIN_ACCEPTED = 30            # minimum-activity user filter
CANDIDATE_LIMIT = 200        # collaborative candidate pool per target
SWEET_LO, SWEET_HI = -0.2, 0.8
ALPHA, BETA = 0.6, 0.4       # final score = alpha * match + beta * boost
CF_BOOST = 0.2               # counterfactual strength boost
PROBLEMS_PER_50_RATING = 10  # ~10 extra solvable items ~ +50 rating
ATTEMPTS_CLIP = 10
TOP_ATTEMPTS = 50            # attempts estimate is attached to the top 50
LATEST_N = 500               # newest attempts kept per user
WEAK_THRESHOLD = 0.7         # weak-tag predicate for the LOO evaluation
RATING_RANGE = (900, 3500)

# Verdict vocabulary.
VERDICT_OK = "OK"
VERDICT_FAIL = ["WRONG_ANSWER", "TIME_LIMIT_EXCEEDED", "MEMORY_LIMIT_EXCEEDED"]

# Rank labels in ladder order.
RANK_ORDER = [
    "newbie", "pupil", "specialist", "expert", "candidate master", "master",
    "international master", "grandmaster",
]

# Success / attempts / growth booster settings of the original models.
SUCCESS_GBT = dict(max_iter=500, step_size=0.05, max_depth=6, min_instances=50, subsample=0.8)
ATTEMPTS_GBT = dict(max_iter=500, step_size=0.05, max_depth=6, min_instances=50, subsample=0.8)
GROWTH_GBT = dict(max_iter=600, step_size=0.03, max_depth=5, min_instances=30, subsample=0.8)
EARLY_STOPPING = 50          # rounds without a better validation error after which boosting stops
# [lo, hi) bands of the current rating in which errors are reported.
ERROR_BANDS = ((900, 1200), (1200, 1600), (1600, 2000), (2000, 2600))

# Profile features of the growth model (fixed values).  The contest features (total_contests, contests_per_year,
# practice_sub_ratio, contest_sub_ratio) and subs_per_active_day have no column in the profile table.
PROFILE_FEATURES = [
    "cf_rating", "first_try_rate", "avg_attempts_to_ac", "unique_problems_solved", "unique_problems_tried",
    "solved_lte_1000", "solved_1001_1500", "solved_1501_2000", "solved_2001_2500", "solved_2501_3000",
    "solved_gt_3000", "tag_coverage_pct", "unique_tags_solved",
]

# Forest size and logistic settings of the original comparison models (fixed values).
FOREST_TREES = 100
LOGISTIC_MAX_ITER, LOGISTIC_C = 1000, 1.0

# ---------------------------------------------------------------------------
# Tunables
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class KnnConfig:
    k: int = K_NEIGHBORS
    metric: str = "euclidean"
    # Rows per KNN block.  Each block pair is one task that computes at most
    # block_rows^2 distances (BLAS, row chunks of 512) and keeps only the k
    # best per row; the shuffle is N * ceil(N / block_rows) rows.
    block_rows: int = 8192


@dataclass(frozen=True)
class RecommendConfig:
    limit: int = CANDIDATE_LIMIT
    alpha: float = ALPHA
    beta: float = BETA
    sweet_lo: float = SWEET_LO
    sweet_hi: float = SWEET_HI
    top_attempts: int = TOP_ATTEMPTS


@dataclass(frozen=True)
class Settings:
    knn: KnnConfig = field(default_factory=KnnConfig)
    recommend: RecommendConfig = field(default_factory=RecommendConfig)
    min_accepted: int = MIN_ACCEPTED


DEFAULT = Settings()
