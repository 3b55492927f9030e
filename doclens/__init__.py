"""doclens: turn labelled text collections into vectors, cluster them, score the clusters."""

__version__ = "0.1.0"
