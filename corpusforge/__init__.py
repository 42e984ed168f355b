"""corpusforge: Spark-native curation of text and sentence-pair corpora.

Every public function takes DataFrames (plus key/column names) and returns
DataFrames.  Work is expressed with the DataFrame API so that Catalyst can
prune, push down and pick join strategies; the only driver-side values are
scalars (counts, thresholds) and bounded histograms.
"""

from corpusforge.session import get_spark, checkpoint_dir, materialize  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir", "materialize"]
