"""Training-data pipeline operators.

Nothing else in the library imports this subpackage.  ``registry`` lists its
queries; ``__spark_entry__`` adds them when the subpackage is present.
"""
