"""Set-at-a-time operators: retrieval, corpus preparation, labels, evaluation."""
