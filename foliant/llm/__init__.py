"""Training-data operators: each module holds one operator; ``registered`` lists their queries."""
