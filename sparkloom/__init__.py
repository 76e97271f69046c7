"""sparkloom: document retrieval and analytics as Spark plans."""
