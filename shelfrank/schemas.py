"""Schemas, column alias map and fixed defaults of the catalog data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Target column order of a clean catalog.
STANDARD_COLUMNS = [
    "product_id", "product_name", "category", "description", "price",
    "rating", "image_url", "user_id", "user_rating",
]

STANDARD_TYPES = {
    "product_id": T.StringType(), "product_name": T.StringType(), "category": T.StringType(),
    "description": T.StringType(), "price": T.DoubleType(), "rating": T.DoubleType(),
    "image_url": T.StringType(), "user_id": T.StringType(), "user_rating": T.DoubleType(),
}

# Source column aliases mapped onto the standard names.
COLUMN_ALIASES = {
    "asin": "product_id",
    "title": "product_name",
    "categories": "category",
    "overall": "rating",
    "imUrl": "image_url",
    "imageURL": "image_url",
    "reviewerID": "user_id",
    "item_id": "product_id",
    "product_title": "product_name",
    "product_category": "category",
    "product_description": "description",
    "unit_price": "price",
    "cost": "price",
    "avg_rating": "rating",
    "stars": "rating",
    "cust_id": "user_id",
    "interaction_rating": "user_rating",
}

# Columns a catalog must have.
REQUIRED_COLUMNS = ["product_id", "product_name", "category", "price", "rating"]

# Imputation defaults and placeholder strings.
DEFAULT_NAME = "Unnamed Product"
DEFAULT_CATEGORY = "Uncategorized"
DEFAULT_DESCRIPTION = "No description available."
DEFAULT_PRICE = 0.0
DEFAULT_RATING = 3.5
PLACEHOLDER_IMAGE_URL = "https://images.example.com/placeholder.jpg"
IMAGE_URL_SENTINELS = ["nan", "None", ""]
VALID_IMAGE_URL_PATTERN = r"(?i)^http|^\.|^/|[a-zA-Z0-9_-]+\.(?:jpg|jpeg|png|webp)"

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("user_id", T.StringType(), True),
    T.StructField("product_id", T.StringType(), True),
    T.StructField("query", T.StringType(), True),
    T.StructField("query_vec", T.ArrayType(T.FloatType()), True),
    T.StructField("top_k", T.IntegerType(), True),
    T.StructField("w_content", T.DoubleType(), True),
    T.StructField("w_collaborative", T.DoubleType(), True),
    T.StructField("w_nlp", T.DoubleType(), True),
    T.StructField("w_image", T.DoubleType(), True),
])

SIGNALS = ["content", "collaborative", "nlp", "image"]

# Default fusion weights and the named weight configurations.
DEFAULT_WEIGHTS = {"content": 0.25, "collaborative": 0.35, "nlp": 0.25, "image": 0.15}

ABLATION_CONFIGS = {
    "1. Content Only": {"content": 1.0, "collaborative": 0.0, "nlp": 0.0, "image": 0.0},
    "2. Collaborative Only": {"content": 0.0, "collaborative": 1.0, "nlp": 0.0, "image": 0.0},
    "3. Content + Collaborative": {"content": 0.40, "collaborative": 0.60, "nlp": 0.0, "image": 0.0},
    "4. Content + Collab + NLP": {"content": 0.30, "collaborative": 0.40, "nlp": 0.30, "image": 0.0},
    "5. Full Hybrid (All Signals)": DEFAULT_WEIGHTS,
}

IMAGE_TOGGLE_CONFIGS = {
    "Image Signal ON": {"content": 0.25, "collaborative": 0.35, "nlp": 0.25, "image": 0.15},
    "Image Signal OFF": {"content": 0.30, "collaborative": 0.40, "nlp": 0.30, "image": 0.0},
}

NLP_TOGGLE_CONFIGS = {
    "NLP Signal ON": {"content": 0.25, "collaborative": 0.35, "nlp": 0.25, "image": 0.15},
    "NLP Signal OFF": {"content": 0.35, "collaborative": 0.45, "nlp": 0.0, "image": 0.20},
}

SENSITIVITY_CONFIGS = {
    "Config A (Default Balanced)": DEFAULT_WEIGHTS,
    "Config B (Collab-Heavy)": {"content": 0.15, "collaborative": 0.55, "nlp": 0.20, "image": 0.10},
    "Config C (NLP-Heavy)": {"content": 0.20, "collaborative": 0.20, "nlp": 0.50, "image": 0.10},
    "Config D (Content/Collab)": {"content": 0.30, "collaborative": 0.40, "nlp": 0.20, "image": 0.10},
}

# Seeds of the multi-seed evaluation.
DEFAULT_EVAL_SEEDS = [42, 7, 21, 100, 123]

# Method labels and explanation sentences shown to users.
METHOD_CONTENT = "Content-Based Filtering (TF-IDF)"
METHOD_COLLAB = "Collaborative Filtering (Item-Item)"
METHOD_POPULAR = "Cold-Start Popularity Strategy"
METHOD_VISUAL = "Visual Embedding Similarity"
METHOD_SEMANTIC = "Semantic Vector Search"
EXPLAIN_COLLAB_PREFIX = "Recommended based on past item ratings by user "
EXPLAIN_POPULAR = "Top-rated popular product across catalog (Cold-Start fallback)"
EXPLAIN_FALLBACK = "Recommended based on catalog popularity and category relevance"
EXPLAIN_LOOKUP_FALLBACK = "Recommended based on overall catalog category matching and popularity."
XAI_NOTICE = "Transparent score attribution model based on weighted signal combination."
