"""The recorded graph of a pipeline: nodes, edges, the session that records them, and their SQL."""
