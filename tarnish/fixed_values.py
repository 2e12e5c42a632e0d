"""Names, lists, tables, constants and texts that results depend on.

Everything in this module is data, stated as text in its natural order. The rest of
the package holds the logic.
"""

# Column roles of the one-row-per-order feature table.
LABEL_COLS = ["y_t1", "y_t2", "y_t3"]
NON_FEATURE_COLS = ["order_id", "split", "y_t1", "y_t2", "y_t3"]

T2_FEATURE_COLS = [
    "purchase_hour",
    "purchase_dow",
    "purchase_month",
    "days_to_estimated",
    "n_items",
    "total_price",
    "total_freight",
    "freight_ratio",
    "max_price",
    "mean_price",
    "n_unique_products",
    "n_unique_sellers",
    "n_payments",
    "total_payment_value",
    "max_installments",
    "payment_type_modal",
    "customer_state",
    "n_seller_states",
    "mean_product_weight_g",
    "mean_product_volume_cm3",
    "dominant_category",
]
T1_EXTRA_FEATURE_COLS = [
    "days_to_approved",
    "days_carrier_to_customer",
    "days_purchase_to_delivery",
    "delivery_vs_estimate_days",
    "order_status",
]
TEXT_COLS = ["review_comment_title", "review_comment_message"]
CATEGORICAL_COLS = ["payment_type_modal", "customer_state", "dominant_category", "order_status"]
MONETARY_COLS = ["total_price", "total_freight", "total_payment_value", "max_price", "mean_price"]
TIME_DAY_COLS = [
    "days_to_estimated",
    "days_to_approved",
    "days_carrier_to_customer",
    "days_purchase_to_delivery",
    "delivery_vs_estimate_days",
]
TAXONOMY_COLS = ["dominant_category"]

# Corruption families, in registry order.
FAMILIES = [
    "missing_injection",
    "type_flip",
    "label_noise_categorical",
    "duplicate_rows",
    "schema_drift",
    "currency_unit_drift",
    "timezone_collapse",
    "category_taxonomy_drift",
    "mojibake_roundtrip",
]

# Category label -> three plausible wrong variants.
TAXONOMY_VARIANTS = {
    "bebes": ["bebê", "bebes_infantil", "bebês"],
    "moveis_decoracao": ["móveis_decoracao", "moveis_decoração", "moveis_e_decor"],
    "esporte_lazer": ["esporte_e_lazer", "esportes_lazer", "esportelazer"],
    "informatica_acessorios": ["informática_acessorios", "informatica_acessórios", "informatica_acc"],
    "telefonia": ["telefonía", "telefonia_cel", "tel"],
    "utilidades_domesticas": ["utilidades_domésticas", "util_domesticas", "utilidade_domestica"],
    "papelaria": ["papelaria_escritorio", "papelaria_e_escritorio", "papel"],
    "perfumaria": ["perfumes", "perfumaria_cosmeticos", "perfum"],
    "beleza_saude": ["beleza_e_saude", "beleza_saúde", "beleza"],
    "automotivo": ["automotivos", "auto", "automotive"],
    "cama_mesa_banho": ["cama_e_mesa_banho", "cama-mesa-banho", "cmb"],
    "brinquedos": ["brinquedo", "brinquedos_jogos", "toys"],
    "ferramentas_jardim": ["ferramentas_e_jardim", "ferramentas/jardim", "jardim_ferramentas"],
    "fashion_bolsas_e_acessorios": ["moda_bolsas_acessorios", "fashion_bolsas", "bolsas_acessorios"],
    "eletronicos": ["eletrônicos", "electronics", "eletronic"],
    "casa_construcao": ["casa_construção", "casa_e_construcao", "construcao_casa"],
    "audio": ["áudio", "audio_video", "som"],
}

# Sweep and gate settings.
SWEEP_FAMILIES = [
    "missing_injection",
    "mojibake_roundtrip",
    "category_taxonomy_drift",
    "currency_unit_drift",
    "schema_drift",
    "type_flip",
]
SEVERITIES = [("low", 0.10), ("med", 0.20), ("high", 0.30)]
SEEDS = [13, 17, 23, 31, 47]
SEEDS_REDUCED = [13, 17, 23]
ROWS_PER_CELL = 1000
GATE_ROWS = 60
GATE_SEED = 13
GATE_THRESHOLD = 2.0
GATE_CONDITIONS = [
    ("missing_injection", 0.20, 13),
    ("missing_injection", 0.20, 17),
    ("mojibake_roundtrip", 0.30, 13),
    ("mojibake_roundtrip", 0.30, 17),
    ("category_taxonomy_drift", 0.30, 13),
    ("currency_unit_drift", 0.20, 13),
]
DELTA_EPSILON = 1e-6

# Model settings.
LR_C = 1.0
LR_MAX_ITER = 2000
LR_TOLERANCE = 1e-4
GBT_TREES = 300
GBT_DEPTH = 6
GBT_STEP = 0.05
GBT_SUBSAMPLE = 0.9
GBT_COLSAMPLE = 0.9
RARE_LEVEL_COUNT = 20
MISSING_LEVEL = "__missing__"
TFIDF_MAX_TERMS = 5000
TFIDF_MIN_DF = 5

# Temporal split boundaries (exclusive ends).
TRAIN_END = "2018-04-01 00:00:00"
VAL_END = "2018-06-01 00:00:00"

# Price in dollars per prompt / completion token.
PROMPT_TOKEN_PRICE = 0.15e-6
COMPLETION_TOKEN_PRICE = 0.60e-6

# Raw input tables: (file name without the export prefix, output name, columns, text may hold line breaks).
RAW_TABLES = [
    ("customers_dataset.csv", "customers",
     [("customer_id", "string"), ("customer_unique_id", "string"), ("customer_zip_code_prefix", "bigint"),
      ("customer_city", "string"), ("customer_state", "string")], False),
    ("geolocation_dataset.csv", "geolocation",
     [("geolocation_zip_code_prefix", "bigint"), ("geolocation_lat", "double"), ("geolocation_lng", "double"),
      ("geolocation_city", "string"), ("geolocation_state", "string")], False),
    ("order_items_dataset.csv", "order_items",
     [("order_id", "string"), ("order_item_id", "bigint"), ("product_id", "string"), ("seller_id", "string"),
      ("shipping_limit_date", "timestamp_ntz"), ("price", "double"), ("freight_value", "double")], False),
    ("order_payments_dataset.csv", "order_payments",
     [("order_id", "string"), ("payment_sequential", "bigint"), ("payment_type", "string"),
      ("payment_installments", "bigint"), ("payment_value", "double")], False),
    ("order_reviews_dataset.csv", "order_reviews",
     [("review_id", "string"), ("order_id", "string"), ("review_score", "bigint"),
      ("review_comment_title", "string"), ("review_comment_message", "string"),
      ("review_creation_date", "timestamp_ntz"), ("review_answer_timestamp", "timestamp_ntz")], True),
    ("orders_dataset.csv", "orders",
     [("order_id", "string"), ("customer_id", "string"), ("order_status", "string"),
      ("order_purchase_timestamp", "timestamp_ntz"), ("order_approved_at", "timestamp_ntz"),
      ("order_delivered_carrier_date", "timestamp_ntz"), ("order_delivered_customer_date", "timestamp_ntz"),
      ("order_estimated_delivery_date", "timestamp_ntz")], False),
    ("products_dataset.csv", "products",
     [("product_id", "string"), ("product_category_name", "string"), ("product_name_lenght", "bigint"),
      ("product_description_lenght", "bigint"), ("product_photos_qty", "bigint"), ("product_weight_g", "bigint"),
      ("product_length_cm", "bigint"), ("product_height_cm", "bigint"), ("product_width_cm", "bigint")], False),
    ("sellers_dataset.csv", "sellers",
     [("seller_id", "string"), ("seller_zip_code_prefix", "bigint"), ("seller_city", "string"),
      ("seller_state", "string")], False),
    ("product_category_name_translation.csv", "category_translation",
     [("product_category_name", "string"), ("product_category_name_english", "string")], False),
]

# Plain-language column descriptions shown in prompts.
COLUMN_DESCRIPTIONS = {
    "purchase_hour": "Hour-of-day (0-23) the customer placed the order.",
    "purchase_dow": "Day-of-week (0=Mon..6=Sun) of the purchase.",
    "purchase_month": "Calendar month (1-12) of the purchase.",
    "days_to_estimated": "Days from purchase timestamp to the carrier-estimated delivery date.",
    "n_items": "Number of items in the order.",
    "total_price": "Sum of item prices in BRL.",
    "total_freight": "Sum of freight (shipping) charges in BRL.",
    "freight_ratio": "total_freight / total_price (cost-of-shipping ratio).",
    "max_price": "Maximum item price in BRL.",
    "mean_price": "Average item price in BRL.",
    "n_unique_products": "Distinct products in the order.",
    "n_unique_sellers": "Distinct sellers fulfilling the order.",
    "mean_product_weight_g": "Average product weight in grams.",
    "mean_product_volume_cm3": "Average product bounding-box volume in cubic cm.",
    "dominant_category": "Most common product category in the order (Portuguese).",
    "n_payments": "Number of payment records (multi-payment orders are common).",
    "total_payment_value": "Sum of payment amounts in BRL.",
    "max_installments": "Largest installment count among payments (1 = pay-in-full).",
    "payment_type_modal": "Most-used payment method: credit_card, boleto, voucher, debit_card, etc.",
    "customer_state": "Brazilian state of the customer (2-letter, e.g. SP, RJ, MG).",
    "n_seller_states": "Distinct seller states fulfilling the order.",
    "days_to_approved": "Days from purchase to approval (T1 only; leaks for T2).",
    "days_carrier_to_customer": "Days from carrier handoff to customer delivery (T1 only; leaks for T2).",
    "days_purchase_to_delivery": "Days from purchase to final delivery (T1 only; leaks for T2).",
    "delivery_vs_estimate_days": "Delivery minus estimate, in days; positive = late (T1 only; leaks for T2).",
    "order_status": "Order lifecycle: delivered, shipped, canceled, etc. (T1 only).",
    "review_comment_title": "Free-form review title written by the customer (Portuguese; often empty).",
    "review_comment_message": "Free-form review body written by the customer (Portuguese; often empty).",
}
NO_DESCRIPTION = "(no description)"

# Task texts shown in prompts: name, goal, meaning of the label.
TASK_TEXTS = {
    "t1": ("predict_review_high",
           "Predict whether the customer left a HIGH review (score 4 or 5) "
           "vs a LOW review (score 1 or 2) for this order.",
           "1 = high review (4-5 stars), 0 = low review (1-2 stars)."),
    "t2": ("predict_late_delivery",
           "Predict whether this order will be delivered LATE — i.e., after "
           "the carrier-estimated delivery date. Only purchase-time features "
           "are available; do not use post-delivery columns.",
           "1 = late delivery, 0 = on-time or early."),
    "t3": ("predict_review_low",
           "Read the customer's Portuguese review text (title and message) "
           "together with order metadata, and predict whether this is a LOW "
           "review (1 or 2 stars) versus a HIGH review (4 or 5 stars). "
           "Reviews with a score of 3 are excluded from this task. The text "
           "fields may be empty; in that case rely on the tabular features.",
           "1 = low review (1-2 stars), 0 = high review (4-5 stars)."),
}

# System message and output contract of a prompt.
SYSTEM_MESSAGE = (
    "You are a careful tabular-data classifier. "
    "Read the column descriptions and one row of data, then return a JSON object "
    "with exactly these keys: prediction (integer 0 or 1), confidence (float in [0,1]), "
    "rationale (string, <= 40 words). Output ONLY the JSON object, no prose, no markdown fences."
)
OUTPUT_CONTRACT = (
    "OUTPUT FORMAT (strict JSON, single line):\n"
    '{"prediction": 0 or 1, "confidence": 0.0..1.0, "rationale": "..."}'
)
PROMPT_TEXT_CHARS = 800
RATIONALE_CHARS = 400

# Text patterns of a profile line.
NUMERIC_PROFILE_LINE = (
    "{col}: numeric  n={n}  miss={miss:.1%}  mean={mean:.3g}  std={std:.3g}  "
    "p10={p10:.3g}  p50={p50:.3g}  p90={p90:.3g}  min={mn:.3g}  max={mx:.3g}  corr_y={corr:+.3f}"
)
CATEGORICAL_PROFILE_LINE = (
    "{col}: categorical  n={n}  miss={miss:.1%}  unique={uniq}  top={top}  prev_y_top={py:.3f}"
)
PROFILE_HEADER = "Training-set profile for task={task}  n_train={n:,}  prevalence(y=1)={prev:.4f}\n"

# The nine call-record fields besides the parsed answer.
CALL_RECORD_SCHEMA = (
    "ts string, task string, mode string, attempt int, ok boolean, error string, latency_s double, "
    "prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, raw string, "
    "parsed struct<prediction:int, confidence:double, rationale:string>"
)
SWEEP_SCHEMA = (
    "ts string, task string, family string, severity_label string, severity double, seed bigint, n bigint, "
    "ml_auc_clean double, ml_auc double, ml_delta double, agent_auc_clean double, agent_auc double, "
    "agent_delta double, abs_ratio_max double, parse_ok bigint"
)
