"""Training-data operators for large text corpora.

Self-contained: nothing outside this folder imports it, and it imports nothing
from the rest of the library.  ``registry`` holds its queries and their SQL.
"""
