"""Multi-step work: train, evaluate, save, load and score; the dashboard payload."""
