"""tarnflow.functions"""
