"""Training-data operators: de-duplication, decontamination, archives, scoring and tokenising.

Nothing outside this folder imports it; ``queries`` holds its catalogue.
"""
