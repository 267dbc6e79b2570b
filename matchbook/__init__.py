"""matchbook: a Spark-native posting recommendation engine.

Postings are cleaned, given a stable identity, de-duplicated, filtered
against what each user has already been scored on, scored against each
user's reference vectors (or by a pluggable text scorer) and ranked per
user.  Every step is a lazy DataFrame transformation.
"""

__version__ = "0.1.0"
