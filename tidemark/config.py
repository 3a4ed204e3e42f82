"""Fixed parameters of the analyses, as published; every operator takes them as arguments."""

from __future__ import annotations

#: Vocabulary: least document frequency, largest share of documents, cap.
MIN_DF, MAX_DF_RATIO, TOP_N_VOCAB = 200, 0.15, 30_000
#: Terms of the keyword study.
KEYWORD_TERMS = 3000
#: Topic model and its fit sample.
N_TOPICS, PER_MONTH_SAMPLE, SEED, NMF_MAX_ITER, NMF_TOL = 14, 3000, 42, 400, 1e-4
#: Topic mapping: a topic is residual under this share, ambiguous from this ratio of second to best on.
MIN_MAP_SHARE, MASS_TIE_RATIO, TOP_TERMS = 0.01, 0.90, 25
#: A regime is active from this z on; months with fewer documents are thin.
ACTIVATION_Z, THIN_MONTH = 0.5, 30
#: Last month of training and first of evaluation in the published study.
TRAIN_END, EVAL_START = "2024-12", "2025-01"
#: Contents are cut at so many characters, exports at so many rows.
CONTENT_CAP, EXPORT_CAP = 200, 20_000
