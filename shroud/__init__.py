"""shroud: corpus-scale personal-data detection, pseudonymization and redaction on Spark.

Everything is expressed with the DataFrame API: regex candidate spans are found with
column expressions, per-document checks run as windows over one ``doc_id`` shuffle,
pseudonyms are keyed hashes, and redaction is a join back to the documents.
"""

__all__ = ["session"]
