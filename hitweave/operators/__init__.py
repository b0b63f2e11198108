"""The retrieval algebra: every operator takes and returns result sets.

A result set is a DataFrame ``(rec_id, score, hit_count, aux_count, hits)`` with one
row for each record: ``hit_count`` occurrences, ``aux_count`` distinct operands that
contributed, and the places of the hits.
"""
