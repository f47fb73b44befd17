"""Text similarity on Spark: TF-IDF search, inspection and duplicates over DataFrames."""

from nearkin.plans.model import SimilarityModel, fit
from nearkin.session import get_session

__all__ = ["SimilarityModel", "fit", "get_session"]
