"""folioflow.plans"""
