"""Multi-step plans: out-of-fold training, stacking, sweeps."""
