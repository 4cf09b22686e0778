"""Operators for preparing training corpora: each is a DataFrame function, none is used by the rest of the library."""
