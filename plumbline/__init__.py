"""plumbline: a Spark-native workload analytics engine."""
