"""Append path: new files of a folder go to the index as they come."""
