"""Part of astrolith."""
