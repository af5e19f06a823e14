"""Training-data operators; nothing else in corvane imports this subpackage."""
