"""Word lists, patterns, edges and defaults that decide results."""

from __future__ import annotations

# --- fixed values: text cleaning -------------------------------------------
SPACE_CHARS = r"[/(){}\[\]|@,;]"
DROPPED_CHARS = r"[^0-9a-z #+_]"
# A "word" character is a letter, a digit or "_", as in Unicode-aware regex engines.
WORD_RUN = r"[\p{L}\p{N}_]{2,}"
WHITESPACE = r"[\t-\r\x{1c}-\x{1f} \x{85}\p{Z}]+"

# --- fixed values: English stop words (public NLTK list) and four additions --
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so
than too very s t can will just don don't should should've now d ll m o re ve
y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't
shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn
wouldn't
""".split()
ADDED_STOPWORDS = ["trust", "fund", "charitable", "charity"]

# --- fixed values: texts a CSV reader takes as missing (public pandas list) --
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- fixed values: rules and code shapes ------------------------------------
EMPTY_RULE = r"\b()\b"

# --- fixed values: bands (right-closed, a value at or below the first edge is null)
INF = float("inf")
INCOME_EDGES = [-1, 10_000, 100_000, 250_000, 500_000, 1_000_000, 10_000_000, INF]
INCOME_LABELS = [
    "Under £10k", "£10k - £100k", "£100k - £250k", "£250k - £500k",
    "£500k - £1m", "£1m - £10m", "Over £10m",
]
SAMPLE_EDGES = [0, 10_000, 100_000, 1_000_000, 10_000_000, INF]
SAMPLE_LABELS = ["Under £10k", "£10k-£100k", "£100k-£1m", "£1m-£10m", "Over £10m"]
PROBABILITY_EDGES = [0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1]
PROBABILITY_LABELS = [
    "0-0.25", "0.25-0.5", "0.5-0.75", "0.75-0.9", "0.9-0.95", "0.95-0.99", "0.99-1",
]

# --- fixed values: unified record columns -----------------------------------
RECORD_FIELDS = [
    "org_id", "reg_number", "name", "postcode", "active", "date_registered",
    "date_removed", "web", "company_number", "activities", "objects", "source",
    "last_updated", "income", "spending", "fye", "grant_making_is_main_activity",
]

# --- fixed values: model and decision defaults ------------------------------
SEED = 42
EVALUATION_SEED = 2026
TEST_SHARE = 0.2
MIN_DF = 3
CLASS_C = 1e5
CLASS_MAX_ITER = 1000
DEFAULT_FIELDS = ("name", "activities")
HYBRID_MAX_LABELS = 1
HYBRID_ROW_CONFIDENCE = 0.25
HYBRID_LABEL_CONFIDENCE = 0.03
LARGEST_RECORDS = 2000

# --- fixed values: objective, guardrails, grid ------------------------------
OBJECTIVE_WEIGHTS = {
    "f1_micro": 0.35, "f1_macro": 0.40, "recall_micro": 0.25, "precision_micro": 0.0,
}
GUARDRAILS = [
    ("precision_micro", ">=", 0.0),
    ("f1_micro", ">=", 0.40),
    ("subset_accuracy", ">=", 0.10),
    ("hamming_loss", "<", 0.016),
    ("jaccard_samples", ">=", 0.0),
]
METRICS = [
    "precision_micro", "recall_micro", "f1_micro", "f1_macro",
    "subset_accuracy", "jaccard_samples", "hamming_loss",
]
GRID_SEEDS = [67, 2026, 42, 123, 321]
GRID_KEYS = [
    "grid_approach", "fields_key", "clean_text", "model_family", "threshold",
    "ngram_max", "char_ngram_max", "model_c", "sgd_loss", "sgd_alpha",
    "class_weight_mode", "fallback_mode", "fallback_min_score", "top_k_fallback",
    "hybrid_label_confidence_threshold",
]
# Settings that change a fit; the rest only change how its scores are read.
FIT_KEYS = [
    "fields_key", "clean_text", "model_family", "ngram_max", "char_ngram_max",
    "model_c", "sgd_loss", "sgd_alpha", "class_weight_mode",
]
SHOW_TOP_KEYS = [
    "clean_text", "model_family", "threshold", "ngram_max", "char_ngram_max",
    "model_c", "sgd_loss", "sgd_alpha", "class_weight_mode", "fallback_mode",
    "fallback_min_score", "top_k_fallback",
]
DEFAULT_APPROACHES = ["ovr_logistic", "ovr_sgd", "hybrid_logistic", "hybrid_sgd"]
APPROACH_GRIDS = {
    "ovr_logistic": {
        "model_family": ["logistic"],
        "threshold": [0.10, 0.20, 0.30, 0.35, 0.40],
        "ngram_max": [1, 2], "char_ngram_max": [0, 5],
        "model_c": [10.0, 20.0, 30.0], "class_weight_mode": ["balanced"],
        "fallback_mode": ["top_k", "max_score_top_1"],
        "top_k_fallback": [0, 1], "fallback_min_score": [0.05, 0.10, 0.15, 0.20],
    },
    "ovr_svc": {
        "model_family": ["linear_svc"],
        "threshold": [-0.75, -0.50, -0.25],
        "ngram_max": [1, 2], "char_ngram_max": [0, 5],
        "model_c": [0.3, 1.0, 2.0, 3.0], "class_weight_mode": ["balanced", "none"],
        "fallback_mode": ["top_k", "max_score_top_1"],
        "top_k_fallback": [0, 1], "fallback_min_score": [-0.25, -0.10, 0.0],
    },
    "ovr_sgd": {
        "model_family": ["sgd"], "sgd_loss": ["modified_huber"],
        "threshold": [0.22, 0.25, 0.275, 0.30, 0.325],
        "ngram_max": [2], "char_ngram_max": [0, 5],
        "sgd_alpha": [0.0002, 0.0003, 0.0004, 0.0005, 0.00075],
        "class_weight_mode": ["none"],
        "fallback_mode": ["top_k", "max_score_top_1"],
        "top_k_fallback": [0, 1], "fallback_min_score": [0.05, 0.10, 0.15, 0.20],
    },
    "hybrid_logistic": {
        "model_family": ["logistic"],
        "threshold": [0.125, 0.15, 0.20, 0.25],
        "ngram_max": [1, 2], "char_ngram_max": [0, 5],
        "model_c": [2500.0, 3000.0, 3500.0, 4000.0], "class_weight_mode": ["none"],
        "fallback_mode": ["top_k", "max_score_top_1"],
        "top_k_fallback": [0, 1], "fallback_min_score": [0.05, 0.10, 0.15, 0.20],
        "hybrid_label_confidence_threshold": [0.00002, 0.00003, 0.00004, 0.00005, 0.000075],
    },
    "hybrid_svc": {
        "model_family": ["linear_svc"],
        "threshold": [-0.4, -0.3, -0.2, -0.1, 0.0],
        "ngram_max": [2], "char_ngram_max": [0, 5],
        "model_c": [0.3, 0.5, 1.0], "class_weight_mode": ["balanced"],
        "fallback_mode": ["top_k", "max_score_top_1"],
        "top_k_fallback": [1], "fallback_min_score": [-0.25, -0.10, 0.0],
        "hybrid_label_confidence_threshold": [0.125, 0.25, 0.35],
    },
    "hybrid_sgd": {
        "model_family": ["sgd"], "sgd_loss": ["log_loss"],
        "threshold": [0.25, 0.275, 0.30, 0.325],
        "ngram_max": [2], "char_ngram_max": [5, 6, 7],
        "sgd_alpha": [0.000003, 0.000005, 0.0000075, 0.00001, 0.000015, 0.00002],
        "class_weight_mode": ["none"],
        "fallback_mode": ["top_k", "max_score_top_1"],
        "top_k_fallback": [0], "fallback_min_score": [0.005, 0.01, 0.015, 0.02],
        "hybrid_label_confidence_threshold": [0.005, 0.0075, 0.01, 0.015],
    },
}


# Endings of English nouns and what stands for them in the base form, in order.
NOUN_ENDINGS = [
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
    ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
]

# Boosted stumps of the classifier comparison.
BOOSTING_ROUNDS = 50
