"""quillspark: document retrieval, ranking, evaluation and corpus-preparation operators as Spark plans."""

__version__ = "0.1.0"
