"""Runnable jobs: each a function of a session, a command line and a small configuration file."""
