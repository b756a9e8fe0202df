"""One function per report; each takes a Star and returns a DataFrame."""
