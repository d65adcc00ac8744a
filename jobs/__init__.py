"""Runnable jobs: each is a function of a session and of paths, with a command line beside it."""
