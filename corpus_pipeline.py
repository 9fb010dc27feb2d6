"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, benchmark decontamination and source mixing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
reread as the next one's docs. ``run(spark, sf_dir)`` applies them to ``documents``. ``ORACLE_SQL`` is None: a fitted
classifier has no SQL.
"""

from tallystone.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
