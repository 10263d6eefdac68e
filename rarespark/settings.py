"""Default settings of the rare-event protocol."""

# --- fixed values -----------------------------------------------------------
# Column names, category tokens, grids, scenario names and labels below must be
# exactly these for results to be comparable; they are data, not logic.
ID_COL = "TransactionID"
TARGET_COL = "isFraud"
MISSING_TOKEN = "__MISSING__"
FREQUENCY_SUFFIX = "_frequency"

CATEGORICAL_NAMES = frozenset(
    ["ProductCD", "card1", "card2", "card3", "card4", "card5", "card6", "addr1", "addr2"]
    + ["P_emaildomain", "R_emaildomain", "DeviceType", "DeviceInfo"]
    + [f"M{n}" for n in range(1, 10)]
    + [f"id_{n:02d}" for n in range(12, 39)]
)

SEED = 42
TRAIN_SHARE = 0.6
VALID_SHARE = 0.2
CLIP = 10.0
K_NEIGHBORS = 5
LATENT_GRID = [8, 16, 32, 64]
RATE_GRID = [0.10, 0.15, 0.20, 0.30, 0.50]
AE_EPOCHS = 60
AE_BATCH = 256
AE_PATIENCE = 8
AE_LEARNING_RATE = 1e-3
N_ESTIMATORS = 2000
SENSITIVITY_ESTIMATORS = 800
PATIENCE_ROUNDS = 100
N_TRIALS = 10

SCENARIOS = [
    ("baseline", "Baseline LightGBM"),
    ("baseline_tuned", "Baseline + Optuna"),
    ("smote", "SMOTE + LightGBM"),
    ("smote_tuned", "SMOTE + Optuna"),
    ("ae_oversample", "AE Latent Oversampling"),
    ("ae_oversample_tuned", "AE Latent + Optuna"),
]

# (name of the delta, scenario, scenario it is compared with)
COMPARISONS = [
    ("ae_vs_baseline", "ae_oversample", "baseline"),
    ("ae_vs_smote", "ae_oversample", "smote"),
    ("ae_vs_baseline_tuned", "ae_oversample_tuned", "baseline_tuned"),
    ("ae_vs_smote_tuned", "ae_oversample_tuned", "smote_tuned"),
]
# --- end of fixed values ----------------------------------------------------

# A key holding at least this share of the rows counts as heavy. By counting, no
# more than 1 / HEAVY_SHARE keys can be heavy, so a table of heavy keys is small
# whatever the size of the data, and safe to broadcast.
HEAVY_SHARE = 1e-3

# Largest lookup tables (rows and bytes, over all columns) sent to every executor, and the
# longest text among the heavy values that are sent of larger tables.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20
HEAVY_TEXT = 1024
