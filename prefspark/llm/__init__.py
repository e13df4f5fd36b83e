"""Training-data operators for very large corpora: each module holds one operator
(its general interface and its registered query); ``catalog`` lists the queries."""
